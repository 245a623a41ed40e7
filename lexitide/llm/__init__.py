"""Operators that prepare text collections as training data for language models.

Nothing outside this package imports it; ``queries`` holds what the entry module registers.
"""
