"""Structured Streaming: keyed state with time-to-live, event routing."""
