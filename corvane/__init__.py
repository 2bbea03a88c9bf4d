"""Retrieval, fusion and evaluation analytics on Spark."""
