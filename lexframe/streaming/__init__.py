"""Streaming forms of the append-only tables' aggregates."""
