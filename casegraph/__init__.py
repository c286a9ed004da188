"""Spark-native analytics over linked investigative records."""
