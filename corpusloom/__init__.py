"""A Spark-native analytics engine for document corpora."""
