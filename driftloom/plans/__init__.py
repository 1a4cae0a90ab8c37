"""Registered queries and learning loops."""
