"""Structured Streaming forms of ingestion and review."""
