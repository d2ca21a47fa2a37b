"""tarn: a PySpark-native engine for relational analytics, vector search and text retrieval."""

__version__ = "0.1.0"
