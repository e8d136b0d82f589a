"""A PySpark-native engine for typed image analytics."""
