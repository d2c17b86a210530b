"""learngraph: a PySpark-native engine that turns document collections into a checked knowledge base."""
