"""Spark-native record fusion: sources, normalisation, conflict resolution, projection, validation and storage as DataFrames."""
