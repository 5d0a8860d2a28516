"""Statistics of tables."""
