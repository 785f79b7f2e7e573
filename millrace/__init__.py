"""Spark-native analytics for text, knowledge stores and event logs."""
