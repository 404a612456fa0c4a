"""Operators for preparing training text: filters, deduplication, tokens, and their named queries."""
