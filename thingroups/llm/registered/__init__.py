"""Thin queries over the operators, one module each."""
