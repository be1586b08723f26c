"""Spark-native engine for personal-context analytics."""
