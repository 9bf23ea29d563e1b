"""Operators for preparing training data: packing, sharding, deduplication, tokenising, search and filtering."""
