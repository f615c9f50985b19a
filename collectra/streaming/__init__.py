"""Applying streams of edits to keyed collections."""
