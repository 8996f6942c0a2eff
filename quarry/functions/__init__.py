"""Column functions: tokenizer, ranking arithmetic."""
