"""Column functions: text, identifiers, vectors, time."""
