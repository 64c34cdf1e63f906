"""Structured Streaming: the live graph and windowed event counts."""
