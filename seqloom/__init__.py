"""Spark-native analytics for grouping assembled sequences into bins."""
