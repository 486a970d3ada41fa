"""Spark-native recommendation, affect and corpus analytics."""
