"""Readers, writers and derived maps."""
