"""A PySpark-native engine for hybrid retrieval, ranking and corpus preparation."""
