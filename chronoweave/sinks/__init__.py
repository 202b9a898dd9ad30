"""Sinks: counts, lines, dumps, written traces."""
