"""PySpark-native terminology extraction, review catalog and text processing."""
