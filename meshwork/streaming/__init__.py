"""Incremental graph aggregates."""
