"""Column and DataFrame functions on text, hashes and vectors."""
