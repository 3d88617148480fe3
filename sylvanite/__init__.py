"""Spark-native mining of labelled graph collections."""
