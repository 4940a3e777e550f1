"""Streams of elements into a graph store (an extension: the query language has none)."""
