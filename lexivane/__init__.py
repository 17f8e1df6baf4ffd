"""Semantic document search, term suggestion and text processing as PySpark plans."""
