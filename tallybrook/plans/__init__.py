"""The plans of the transaction engine."""
