"""Column functions: built-in expressions, plus one Arrow function for code syntax."""
