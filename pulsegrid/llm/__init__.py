"""Operators for preparing training data of language models, one module each."""
