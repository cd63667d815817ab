"""A Spark-native engine for curating documents and measuring structured extraction."""
