"""Training-data operators: filtering, scoring, deduplication, tokenising and sharding of text corpora.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame, picks the columns it needs by exact
name (further columns, also ones whose names differ only in case or clash with its outputs, are ignored) and
returns a new DataFrame.
"""
