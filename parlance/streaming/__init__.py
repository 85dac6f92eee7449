"""Structured Streaming forms of operators that keep up with growing input."""
