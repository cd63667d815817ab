"""Operators for preparing training data: tokenisation, deduplication, filtering, redaction and sharding."""
