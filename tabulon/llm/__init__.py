"""Operators and queries that prepare text for language-model training."""
