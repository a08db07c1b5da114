"""The streaming of the transaction engine."""
