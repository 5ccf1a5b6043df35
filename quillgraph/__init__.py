"""Spark-native analytics over software-knowledge graphs."""
