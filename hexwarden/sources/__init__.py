"""Landed files and stored tables."""
