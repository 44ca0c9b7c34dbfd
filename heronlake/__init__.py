"""Retrieval, evaluation and feedback analytics expressed as Spark DataFrame jobs."""
