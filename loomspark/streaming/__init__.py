"""Streaming twins of aggregates, dedupe and the trailing-window stop rules."""
