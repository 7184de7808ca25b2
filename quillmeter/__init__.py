"""PySpark-native analytics for the usage logs of AI coding tools."""
