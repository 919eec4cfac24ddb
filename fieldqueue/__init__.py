"""Spark-native analytics for randomised review queues over records, events, labels and vectors."""
