"""Structured Streaming: message pipelines, keyed state and windowed activity."""
