"""Spark-native retrieval and analysis over code and text corpora."""
