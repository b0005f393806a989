"""Spark-first analytics over volumetric chunks, labels, tables, documents and event streams."""
