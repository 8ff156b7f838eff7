"""Relational operators: similarity joins, components, watched matching, groups, moves, reports."""
