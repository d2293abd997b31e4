"""Tile planning and corpus preparation as Spark DataFrame programs."""
