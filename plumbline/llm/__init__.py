"""Operators for large training corpora, one module each; `queries` registers them over the given tables."""
