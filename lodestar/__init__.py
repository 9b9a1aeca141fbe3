"""lodestar: a PySpark-native engine for retrieval and event-fold analytics."""
