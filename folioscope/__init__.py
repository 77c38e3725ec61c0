"""Spark-native page-quality analytics."""
