"""Column functions: text, similarity, addresses, scores."""
