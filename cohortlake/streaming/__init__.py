"""Streamed ingestion."""
