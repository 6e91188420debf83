"""Operators over DataFrames: corpora, records, links, relational shapes."""
