"""Operators on feature tables, labels, scores and models."""
