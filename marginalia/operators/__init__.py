"""Operators: links, graph, ranking, metrics, statistics, facet index, search, audits and lifecycle, as functions on DataFrames."""
