"""Kestrel: code search and corpus preparation on PySpark."""
