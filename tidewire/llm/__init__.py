"""Operators for large text corpora: deduplication, quality, tokenising, mixing."""
