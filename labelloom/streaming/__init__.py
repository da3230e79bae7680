"""Structured Streaming form of the incremental ingest."""
