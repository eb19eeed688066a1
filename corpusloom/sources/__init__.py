"""Readers of document trees, their metadata and stored state."""
