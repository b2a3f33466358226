"""Reusable plan shapes: two-level windows, skew-safe expansion, recursion by joins, shared tables."""
