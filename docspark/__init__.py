"""A PySpark-native engine for searching and answering questions over document collections."""
