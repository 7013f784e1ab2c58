"""Relational operators with column-name parameters: filters, joins, aggregates, windows, pages."""
