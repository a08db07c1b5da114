"""The operators of the transaction engine."""
