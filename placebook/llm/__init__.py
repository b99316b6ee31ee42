"""Operators for building training data from text, as Spark jobs."""
