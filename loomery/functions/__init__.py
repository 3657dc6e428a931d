"""Column functions: text, similarity, URLs, extraction."""
