"""DataFrame operators: grouped aggregations, joins and windows."""
