"""Operators over the variants DataFrame."""
