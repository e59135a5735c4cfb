"""Spark-native code, document and table intelligence engine."""
