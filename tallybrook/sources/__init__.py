"""The sources of the transaction engine."""
