"""Spark-native evidence engine for positive-only call tables, and the operators around it."""
