"""Operators for preparing language-model training data; nothing else of the package imports them."""
