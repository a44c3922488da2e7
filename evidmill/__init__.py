"""Retrieval-evaluation and research-process analytics as Spark DataFrame operators."""
