"""Spark-native analytics over code-hosting metadata."""
