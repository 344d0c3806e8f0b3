"""Column expressions: labels, texts and model responses."""
