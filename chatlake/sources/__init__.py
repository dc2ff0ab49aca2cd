"""Readers and keyed writers for the source and lake tables."""
