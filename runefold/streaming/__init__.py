"""Structured Streaming forms: log ingestion, incremental state, and rate limiting with state."""
