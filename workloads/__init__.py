"""Queries over the given tables, one per operator or job, each with its SQL."""
