"""Plans over several operators: the store."""
