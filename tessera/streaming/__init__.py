"""Streaming of the entity-intelligence engine."""
