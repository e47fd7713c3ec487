"""Structured Streaming forms of the log and the rate limit."""
