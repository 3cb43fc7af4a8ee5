"""Column functions: identity, freshness, validation, messages."""
