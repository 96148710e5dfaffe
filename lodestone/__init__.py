"""Spark-native document retrieval and workspace analytics."""
