"""Spark-native seasonal early-warning analytics over time-series and gridded tables."""
