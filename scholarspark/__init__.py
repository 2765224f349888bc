"""Spark-native operators for grounding, search and analytics over document collections."""
