"""Training-data operators that work on whole corpora.

Nothing outside this subpackage imports it, so it can be removed as one piece.
"""
