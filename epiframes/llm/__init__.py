"""Training-data operators: encoding, deduplication, filtering, sharding of text corpora.

Nothing else in the library imports this subpackage.  Every operator module holds a general
function on DataFrames; ``queries.py`` derives the fixed result columns from them.
"""
