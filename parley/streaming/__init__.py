"""Continuous load with Structured Streaming."""
