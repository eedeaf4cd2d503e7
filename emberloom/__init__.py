"""emberloom: mark-similarity and confusion-risk analytics as PySpark plans."""

__version__ = "0.1.0"
