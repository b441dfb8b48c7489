"""Incremental ingest and keyed state."""
