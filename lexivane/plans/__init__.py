"""Whole pipelines made of the operators."""
