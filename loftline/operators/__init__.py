"""Relational operators: filters, joins, ranks, merges, pairs."""
