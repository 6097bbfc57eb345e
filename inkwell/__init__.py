"""Corpus quality and training-data operators for PySpark."""
