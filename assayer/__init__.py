"""Spark-native model scoring and generalised linear models."""
