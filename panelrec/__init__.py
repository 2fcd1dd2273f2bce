"""Spark-native operators for recommendation panels, decisions and evaluation."""
