"""Column expressions, and jobs made of them, on texts and vectors."""
