"""Spark-native engine for curating and scoring language-model training data."""
