"""Relational building blocks: filters, cleaning steps, joins, rankings, rules."""
