"""Structured Streaming jobs; each has a batch twin that gives the same rows."""
