"""Exact-snapshot analytics on PySpark, and operators for training-data corpora."""
