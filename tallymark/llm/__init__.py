"""Training-data operators: filtering, deduplication, masking, packing and output of text corpora.

Nothing outside this folder imports it. Operators take and return DataFrames; ``queries`` holds the
thin queries that apply them to the standard tables.
"""
