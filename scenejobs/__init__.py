"""Spark jobs for driving-scene data: maps, tracks, rasters, lane graphs and their metrics."""
