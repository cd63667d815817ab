"""Incremental processing of append-only logs."""
