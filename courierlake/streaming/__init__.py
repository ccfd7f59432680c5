"""Incremental ingest and windows over streams."""
