"""Spark-native extraction, cleaning and comparison of string tables."""
