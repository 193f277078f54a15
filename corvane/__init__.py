"""Corvane: a Spark-native engine for versioned document corpora and evidence retrieval."""
