"""Structured Streaming segmenter and its batch replay."""
