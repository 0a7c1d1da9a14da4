"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries over the `documents` table are in `queries`.
"""
