"""almanack: a PySpark-native engine for dated, semi-structured text entries."""
