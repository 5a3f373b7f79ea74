"""Column functions: text, identifiers, parsing, similarity, scoring, classification."""
