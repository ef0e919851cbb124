"""Structured Streaming forms of the ingest, dedupe, burst and window-statistics steps."""
