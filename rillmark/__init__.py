"""Spark-native retrieval analytics: DataFrames in, DataFrames out."""
