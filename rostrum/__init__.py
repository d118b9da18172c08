"""rostrum: a PySpark-native engine for ordered-text analytics."""
