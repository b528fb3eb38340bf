"""Operators of the entity-intelligence engine."""
