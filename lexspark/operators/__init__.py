"""Operators of lexspark."""
