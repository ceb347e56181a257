"""Spark-native operators for point-in-time event studies on filing, price and identifier data."""
