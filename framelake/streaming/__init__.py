"""Stateful and windowed operators over streams."""
