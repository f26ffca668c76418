"""Column functions: paths, rules, extraction, text."""
