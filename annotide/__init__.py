"""Temporal annotation analytics on PySpark."""
