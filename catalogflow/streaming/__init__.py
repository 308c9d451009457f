"""Structured Streaming versions of the event-frame and scoring operators."""
