"""A Spark-native engine for news analytics and for preparing text corpora."""
