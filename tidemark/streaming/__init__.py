"""Structured Streaming: the change tail as state, and event-time windows."""
