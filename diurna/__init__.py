"""Spark-native analytics over many independent, gappy, minute-resolution count series."""
