"""Incremental upkeep of flow tables with Structured Streaming."""
