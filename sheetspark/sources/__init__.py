"""Readers: text formats, GDSII, configuration."""
