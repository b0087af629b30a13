"""Operators for building training corpora: filters, counts, near-duplicates, mixing, models, privacy."""
