"""The query language: syntax, analysis, and lowering to DataFrames."""
