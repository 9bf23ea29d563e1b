"""Incremental cube builds from streams."""
