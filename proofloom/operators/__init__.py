"""DataFrame operators grouped by the data they work on."""
