"""Corpus analytics on Spark: facets, links, graphs, retrieval, evaluation and audits as DataFrame plans."""
