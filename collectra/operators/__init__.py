"""Operators on sequences (idx, value), sets (value), maps (key, value) and graphs (id; src, dst, value)."""
