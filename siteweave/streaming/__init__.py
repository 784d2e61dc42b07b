"""Structured Streaming: page ingest and the replayed frontier."""
