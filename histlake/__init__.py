"""histlake: a PySpark-native engine for version-control history."""
