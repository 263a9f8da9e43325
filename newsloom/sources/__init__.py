"""Readers and writers for the engine's tables."""
