"""Batch sources and generators."""
