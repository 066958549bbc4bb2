"""Spark-native table-benchmark engine: sources, cleaning, splits, serialization, scoring, metrics, ranking."""
