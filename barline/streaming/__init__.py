"""Structured Streaming forms of sync, resampling and ingest."""
