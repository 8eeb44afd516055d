"""Incremental rollups and keyed updates with Structured Streaming."""
