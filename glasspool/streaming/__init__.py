"""Continuous ingest of node documents."""
