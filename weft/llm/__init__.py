"""Operators for training-data pipelines.

Nothing outside this subpackage imports it. ``weft.llm.queries`` registers one
query per operator; each operator module keeps its own general interface.
"""
