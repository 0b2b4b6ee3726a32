"""Structured Streaming: webhook deliveries and incremental indexing."""
