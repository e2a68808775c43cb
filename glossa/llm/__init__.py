"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries`` registers
the thin queries over the driver tables.
"""
