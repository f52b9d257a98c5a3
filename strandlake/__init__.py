"""Sequence, vector and table analytics expressed as Spark DataFrame jobs."""
