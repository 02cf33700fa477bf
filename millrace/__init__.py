"""Retrieval analytics on PySpark: a corpus is a DataFrame with ``uri`` and ``content``."""
