"""Operators for the text and vectors of language-model training data. Nothing outside this package imports it."""
