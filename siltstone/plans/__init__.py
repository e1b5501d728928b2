"""Composed pipelines and the query catalogue."""
