"""Spark DataFrame operators for property tables, retrieval context and evaluation."""
