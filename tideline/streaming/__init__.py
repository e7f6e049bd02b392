"""Structured Streaming forms of the event and job analyses."""
