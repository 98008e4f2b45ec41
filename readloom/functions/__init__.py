"""Column functions: sequences, tokens, labels and statistics."""
