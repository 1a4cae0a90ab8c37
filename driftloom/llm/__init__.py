"""Operators for preparing training text: classification, deduplication, filtering, encoding."""
