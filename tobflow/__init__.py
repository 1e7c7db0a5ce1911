"""A PySpark engine for top-of-book market data."""

__version__ = "0.3.0"
