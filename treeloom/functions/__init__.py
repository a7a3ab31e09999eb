"""Part of treeloom."""
