"""PySpark-native analytics over recorded model-evaluation runs."""
