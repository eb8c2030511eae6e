"""Column functions: tokens, text, importance, truncation, model answers, display."""
