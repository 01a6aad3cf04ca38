"""Column expressions: no actions, no Python in workers."""
