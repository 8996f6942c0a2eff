"""Corpus sources and the corpus generator."""
