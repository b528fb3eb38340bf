"""Sources of the entity-intelligence engine."""
