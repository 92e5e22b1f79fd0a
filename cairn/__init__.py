"""cairn: a PySpark-native engine for evidence, page and training-text data."""
