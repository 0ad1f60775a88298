"""Spark-native embedding ETL and vector retrieval."""
