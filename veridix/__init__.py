"""Spark-native analytics for grounded question answering and evaluation."""
