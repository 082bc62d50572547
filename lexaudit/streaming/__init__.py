"""Thin structured-streaming wrappers."""
