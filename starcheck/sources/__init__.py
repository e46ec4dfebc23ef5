"""Readers and writers for the review tables."""
