"""Streams of file events."""
