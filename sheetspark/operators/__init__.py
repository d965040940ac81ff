"""Relational and numerical operators on layouts and sheet networks."""
