"""quillon: a PySpark-native document-retrieval analytics engine."""
