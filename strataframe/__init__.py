"""A PySpark-native analytics engine for spatial-resource and operations data."""
