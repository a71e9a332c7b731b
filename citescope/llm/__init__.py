"""Operators for preparing training corpora, each a function of DataFrames."""
