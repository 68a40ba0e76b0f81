"""The pipeline's operators on DataFrames of polygons, lines and graphs."""
