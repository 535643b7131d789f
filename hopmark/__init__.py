"""Spark-native analytics for sequences of 16-bit packet identifiers."""
