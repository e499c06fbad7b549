"""Capturing and applying changes with Structured Streaming."""
