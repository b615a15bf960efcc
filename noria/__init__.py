"""A Spark-native engine for preparing and analysing speech and text corpora."""
