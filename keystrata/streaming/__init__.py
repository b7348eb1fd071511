"""Structured Streaming: ingest into runs, and the rate limiter with kept state."""
