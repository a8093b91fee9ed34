"""Streaming forms of window and sequence operators."""
