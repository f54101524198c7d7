"""Spark-native analytics over notes kept as DataFrames."""
