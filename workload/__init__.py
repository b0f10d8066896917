"""Queries over the test tables, with the SQL they are compared to."""
