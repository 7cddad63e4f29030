"""A PySpark-native engine for static text embeddings."""
