"""Relational operators: frames, groupings and windows."""
