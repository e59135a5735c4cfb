"""Structured Streaming: watching files, touch counters, windows."""
