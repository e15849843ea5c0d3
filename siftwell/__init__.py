"""A Spark-native engine for retrieval analytics over document corpora."""
