"""Column expressions: hashing, score vectors, text and pixels."""
