"""Structured Streaming runner and its state tables."""
