"""Operators for building training corpora: extraction, deduplication, filtering and mixing."""
