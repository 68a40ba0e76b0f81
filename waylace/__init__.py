"""waylace: centreline networks from road-surface polygons, expressed as Spark plans."""

__version__ = "0.1.0"
