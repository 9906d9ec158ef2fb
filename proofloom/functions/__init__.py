"""Column functions: pure expressions, no DataFrame, no Python in the executor."""
