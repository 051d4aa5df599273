"""Incremental annotation of arriving variant files."""
