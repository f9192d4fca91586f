"""Operators on text corpora: scoring, deduplication, tokens, quality, decontamination, archives."""
