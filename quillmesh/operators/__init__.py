"""Relational operators of the intake plan."""
