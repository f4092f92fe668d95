"""Operators for source code and texts as training data. Nothing outside this subpackage imports it."""
