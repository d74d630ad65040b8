"""Queries by name, with the SQL that gives the same rows where SQL can."""
