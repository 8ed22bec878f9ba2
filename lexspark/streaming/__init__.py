"""Streaming of lexspark."""
