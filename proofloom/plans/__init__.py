"""Compositions of operators that answer one reporting question end to end."""
