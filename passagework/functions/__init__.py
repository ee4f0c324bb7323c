"""Column functions: text clean-up, cross-references, identities, vectors."""
