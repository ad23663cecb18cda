"""Spark-native anomaly analytics for machine sensor streams."""
