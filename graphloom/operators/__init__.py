"""Graph and rule operators."""
