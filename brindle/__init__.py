"""Spark-first relational, streaming and text-analytics operators."""
