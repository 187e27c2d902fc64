"""Readers for Bronze inputs and stored tables, and the source catalogue."""
