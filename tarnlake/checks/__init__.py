"""Queries over the driver tables, one per operator, each beside the SQL that must give the same rows."""
