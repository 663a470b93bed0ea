"""Plans over streams."""
