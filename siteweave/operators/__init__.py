"""Relational operators and the checks made of them."""
