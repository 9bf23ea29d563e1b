"""Readers, writers, path enumeration and the catalog store."""
