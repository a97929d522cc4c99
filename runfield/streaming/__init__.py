"""Grids that arrive row by row."""
