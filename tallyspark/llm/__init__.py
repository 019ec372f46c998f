"""Operators for text corpora: percentiles, conversations, token ids, leaked evaluation texts, text quality.

Nothing outside this package imports it.
"""
