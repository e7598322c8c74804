"""Scalar and ranking expressions."""
