"""Readers of messy sheets and writers of result tables."""
