"""Operators for preparing training data of language models. Nothing outside this package imports it."""
