"""Statistics over streams."""
