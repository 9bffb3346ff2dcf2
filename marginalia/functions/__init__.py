"""Column functions: text, tokens and facets."""
