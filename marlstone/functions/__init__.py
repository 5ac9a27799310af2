"""Column functions: text, codes, instructions, scores and vectors."""
