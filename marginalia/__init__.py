"""Annotation analytics on Spark: sources, functions, operators, plans and streaming for reader annotations."""
