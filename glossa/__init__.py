"""glossa: a PySpark-native engine for citation graphs over document corpora."""
