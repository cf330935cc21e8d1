"""Spark-native analytics over regulatory enforcement records."""
