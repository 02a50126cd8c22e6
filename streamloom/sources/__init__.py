"""Readers, writers and the record schemas."""
