"""Whole jobs: scoring, frontier selection, record normalization, and the registered queries."""
