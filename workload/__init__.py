"""Queries over the test tables, their views and the SQL that checks them."""
