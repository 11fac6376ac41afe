"""Operators for preparing training data: deduplication, packing, mixing, sharding, archives and search."""
