"""Operators for preparing language-model training data: counting, encoding, filtering, deduplicating, archiving, packing."""
