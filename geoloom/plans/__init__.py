"""Shared plan shapes: ordered scans, cell joins, chain ranking, scratch tables."""
