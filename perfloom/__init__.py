"""A PySpark-native analytics engine for performance-engineering benchmark records."""
