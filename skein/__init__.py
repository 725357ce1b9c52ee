"""Search-index analytics on PySpark: wide versioned documents, ranked search, facets, change feeds."""

__version__ = "0.1.0"
