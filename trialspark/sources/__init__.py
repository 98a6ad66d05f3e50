"""Readers, writers, identifiers and unit views."""
