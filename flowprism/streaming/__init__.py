"""Structured Streaming pipelines over packet streams."""
