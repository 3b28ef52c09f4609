"""Structured Streaming: index refresh and streaming search."""
