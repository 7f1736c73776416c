"""Operators for preparing training text: counting, deduplication, search, sharding,
packing, quality, personal data and tokenisation. Nothing else in the library imports this."""
