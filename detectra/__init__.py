"""Spark-native simulation reliability analytics."""
