"""loomspan: mapping, memoising, hashing and persisting data as PySpark plans."""

__version__ = "0.1.0"
