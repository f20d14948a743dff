"""Queries over the provided tables, one for each operator, with the SQL that states their rows."""
