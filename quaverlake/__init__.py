"""Spark-native operators for timed media, catalogue text and event histories."""
