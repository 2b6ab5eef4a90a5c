"""Incremental basket ingestion with Structured Streaming."""
