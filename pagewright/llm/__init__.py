"""Operators that prepare text for training corpora.  Nothing outside this package imports it."""
