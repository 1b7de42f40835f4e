"""Spark-native analytics for bilingual interview conversations."""
