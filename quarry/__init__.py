"""Quarry: a PySpark-native engine for integrating, verifying and searching semi-structured records."""
