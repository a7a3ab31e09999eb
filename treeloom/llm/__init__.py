"""Operators on texts: token ids, packing, abusive content. Nothing outside imports this package."""
