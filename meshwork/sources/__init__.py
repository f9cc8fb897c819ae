"""Graphs derived from tables, and graph file formats."""
