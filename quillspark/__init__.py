"""Spark-native catalogue search and reconciliation engine."""
