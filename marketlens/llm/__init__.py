"""Operators for preparing training text: archives, filters, deduplication, tokens, packing, sharding."""
