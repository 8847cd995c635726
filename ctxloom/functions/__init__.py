"""Column builders: paths, texts and predicates."""
