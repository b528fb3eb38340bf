"""Functions of the entity-intelligence engine."""
