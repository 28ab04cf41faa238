"""Column builders: instants, identifiers, words, belief arithmetic."""
