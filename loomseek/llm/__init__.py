"""Operators on training text: markup, near-duplicates, language, quality,
nearest vectors, splitting, token ids, leakage and repetition.

Nothing else in the library imports this package.
"""
