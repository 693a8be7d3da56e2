"""Sparquill: a PySpark-native engine for evaluation-benchmark analytics."""
