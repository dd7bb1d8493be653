"""Queries over the given tables, one for each operator, with SQL where SQL can express them."""
