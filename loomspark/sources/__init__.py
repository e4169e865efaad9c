"""Readers and writers of JSON, JSONL, text, CSV and Parquet data."""
