"""Structured Streaming: live feeds and stateful rules."""
