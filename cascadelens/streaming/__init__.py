"""Structured Streaming over deliveries."""
