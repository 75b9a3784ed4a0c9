"""A PySpark-native engine for a compact SQL data-movement and analytics dialect."""
