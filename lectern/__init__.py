"""Lectern: a Spark-native engine for building, searching and analysing a corpus of papers."""
