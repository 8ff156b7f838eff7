"""Incremental maintenance of the signature cache by Structured Streaming."""
