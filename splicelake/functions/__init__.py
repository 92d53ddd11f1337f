"""Column functions on sequences, phases and identifiers."""
