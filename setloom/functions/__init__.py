"""Column functions: alphabets, the sketch hash, similarity measures."""
