"""Structured Streaming forms of windowed and anchored counts."""
