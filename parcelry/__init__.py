"""Spark-native housing analytics."""
