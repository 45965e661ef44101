"""Stateful and resumable operators on Structured Streaming."""
