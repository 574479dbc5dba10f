"""Column expressions and numpy routines for grouped maps."""
