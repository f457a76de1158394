"""Operators for preparing training data, one module each; nothing else in the library imports them."""
