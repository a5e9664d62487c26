"""Spark-native event-study and disclosure analytics."""
