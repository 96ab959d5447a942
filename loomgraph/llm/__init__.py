"""Training-data operators: quality, tokens, near copies, scoring, filters, search.

Nothing outside this subpackage imports it.
"""
