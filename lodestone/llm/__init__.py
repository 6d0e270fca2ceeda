"""Operators for building training data: sharding, mixing, tokens, dedup, scans, search and filters."""
