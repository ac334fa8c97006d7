"""Structured Streaming jobs on top of the batch operators."""
