"""PySpark-native corpus analytics and retrieval."""
