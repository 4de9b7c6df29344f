"""Spark-native analytics for memory, retrieval, evaluation and corpus preparation."""
