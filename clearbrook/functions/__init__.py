"""Column builders: text, numbers, dates."""
