"""Readers and tables."""
