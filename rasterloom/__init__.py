"""Spark-native analytics over dense (epoch, row, col) arrays, plus corpus operators in ``llm``."""
