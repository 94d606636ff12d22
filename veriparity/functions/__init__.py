"""Column builders: expressions over columns, no DataFrame and no action."""
