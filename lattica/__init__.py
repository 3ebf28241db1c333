"""Spark-native analytics over document, embedding and similarity-graph tables."""
