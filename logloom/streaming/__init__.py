"""The batch transforms on unbounded tables."""
