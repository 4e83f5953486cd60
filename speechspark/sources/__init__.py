"""Readers, validation and writers for recordings, chunks and results."""
