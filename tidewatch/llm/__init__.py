"""Corpus operators for training data: one module per operator, and ``queries`` for the registered queries."""
