"""Column functions: scalar helpers and predicate text."""
