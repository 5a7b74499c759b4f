"""A PySpark-native study-intelligence engine."""
