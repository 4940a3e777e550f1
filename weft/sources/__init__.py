"""Graphs from files and tables, and results to files."""
