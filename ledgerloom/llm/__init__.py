"""Operators for building training corpora: tokenising, filtering, de-duplicating and formatting.

Nothing else in the library imports this subpackage.  Each module holds one operator that takes
and returns DataFrames; ``queries`` registers one whole-table query for each of them.
"""
