"""Readers, writers and the ingest of call tables."""
