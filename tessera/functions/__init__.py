"""Statistics as expressions and small tables."""
