"""Spark-native analytics for segmented, multi-sample evaluation data."""
