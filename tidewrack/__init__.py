"""A PySpark-native analytics engine for literature-derived field observations."""
