"""Ferrule: a PySpark-native retrieval and conversational-memory analytics engine."""
