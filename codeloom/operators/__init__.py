"""Relational, graph, vector and temporal operators on DataFrames."""
