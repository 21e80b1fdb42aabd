"""Spark-native catalogue search, matching and ingest operators."""
