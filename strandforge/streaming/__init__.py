"""streaming of the sequence engine."""
