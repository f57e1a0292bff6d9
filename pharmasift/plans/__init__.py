"""Compositions of operators offered as single calls."""
