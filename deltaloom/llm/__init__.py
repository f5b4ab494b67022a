"""Corpus operators for training data: deduplication, filtering, scoring, packing."""
