"""Relational operators of the re-ranking pipeline (DataFrame in, DataFrame out)."""
