"""treeloom: a PySpark engine for versioned, hierarchical source-text data."""

__version__ = "0.1.0"
