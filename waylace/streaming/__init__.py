"""Incremental runs over polygons that arrive in batches."""
