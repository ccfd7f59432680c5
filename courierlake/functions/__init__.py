"""Expressions and per-message functions."""
