"""Whole pipelines, settings and queries."""
