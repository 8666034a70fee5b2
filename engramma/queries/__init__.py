"""Registered queries over the input tables, with the SQL that each must equal."""
