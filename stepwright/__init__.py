"""A PySpark-native engine for step-level supervision data."""
