"""Streaming ingestion into the event log."""
