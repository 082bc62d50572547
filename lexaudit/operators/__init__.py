"""Relational operators: span algebra, phrase search, resolution, evaluation."""
