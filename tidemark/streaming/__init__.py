"""Scenes as a stream."""
