"""Spark-native analysis of embedding vectors."""
