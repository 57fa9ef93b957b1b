"""Versioned-tree analytics on Spark: an append-only delta ledger queried as DataFrames."""
