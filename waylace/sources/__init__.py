"""Readers and writers: derived tables, shapefiles, GeoJSON, stage snapshots."""
