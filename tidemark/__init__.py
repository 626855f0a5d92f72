"""A PySpark engine for archive listings and for corpora of text."""
