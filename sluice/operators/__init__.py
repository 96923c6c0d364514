"""Operators over DataFrames of texts, page elements, sessions and ledgers."""
