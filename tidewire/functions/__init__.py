"""Column builders: text, similarity, hashes, time."""
