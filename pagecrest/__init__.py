"""Spark-native book and document analytics."""
