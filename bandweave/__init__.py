"""Windowed band joins over Spark DataFrames and streams."""
