"""Readers of source tables and writers of result tables."""
