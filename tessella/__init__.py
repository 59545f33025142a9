"""Tessella: a PySpark-native engine for long-term text memory and training-data work."""
