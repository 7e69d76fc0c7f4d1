"""Tessera: a PySpark-native engine for sensor and sequence data."""
