"""Operators for preparing training data: deduplication, filters, tokens, packing, shards."""
