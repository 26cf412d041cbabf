"""Spark-native analytics for spatial vessel networks."""
