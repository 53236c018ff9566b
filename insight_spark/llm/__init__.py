"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers one query for each. Nothing else
in the library imports this package.
"""
