"""plans of the sequence engine."""
