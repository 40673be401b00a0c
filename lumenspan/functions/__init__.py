"""Column builders: vectors, scores and text."""
