"""Operators for large text, vector and web corpora. Nothing else in the library imports this subpackage."""
