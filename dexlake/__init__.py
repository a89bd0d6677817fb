"""A PySpark-native analytics engine for application artifacts."""
