"""Training-data operators: tokenizing, cleaning, deduplicating and packaging text at corpus scale.

Nothing else in the library imports this subpackage.
"""
