"""Sinks: published tables."""
