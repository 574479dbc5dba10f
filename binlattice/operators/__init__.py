"""Operators over contact maps."""
