"""Spark-native analytics over transaction ledgers."""
