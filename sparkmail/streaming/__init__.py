"""Incremental ingest: the table store and the Structured Streaming drivers."""
