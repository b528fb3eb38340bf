"""Plans of the entity-intelligence engine."""
