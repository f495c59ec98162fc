"""Operators that clean training text. Nothing outside this subpackage imports it."""
