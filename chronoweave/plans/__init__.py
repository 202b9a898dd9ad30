"""Graphs, queries, the facade, and the catalogue of named queries."""
