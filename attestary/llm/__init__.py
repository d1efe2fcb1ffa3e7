"""Operators for preparing training data: deduplication, scoring, mixing, sharding, packing, search."""
