"""Column-level building blocks: text, arrays, vectors and score functions."""
