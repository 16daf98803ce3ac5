"""Queries over the benchmark tables, one per operator, and the SQL that checks them."""
