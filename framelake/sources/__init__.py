"""Readers that give tables."""
