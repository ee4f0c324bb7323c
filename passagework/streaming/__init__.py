"""Structured Streaming forms of ingestion and rate control."""
