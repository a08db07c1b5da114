"""The functions of the transaction engine."""
