"""Operators for training-data corpora: search, deduplication, scans, models, archives and packing."""
