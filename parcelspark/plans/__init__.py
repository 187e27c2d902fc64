"""The full build and the registered queries with their SQL twins."""
