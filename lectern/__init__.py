"""Spark-first analytics for document-reading workloads."""
