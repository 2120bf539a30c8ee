"""Relational operators, one module per family."""
