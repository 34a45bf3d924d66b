"""Tidemark: a Spark-native engine for panels of time series and collections of documents."""
