"""Spark-native engine for statistical downscaling and bias correction of climate series."""
