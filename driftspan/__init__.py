"""Spark-native drift analytics."""
