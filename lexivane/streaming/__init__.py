"""Incremental versions of the batch operators."""
