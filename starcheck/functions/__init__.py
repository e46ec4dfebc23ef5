"""Column expressions: text rules, word lists, labels and rounding."""
