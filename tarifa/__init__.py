"""Spark-native retail price-intelligence analytics."""
