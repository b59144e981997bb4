"""Tessera: a PySpark-native engine for catalogue search, record linkage and corpus curation."""
