"""Predicates, aggregates, joins and ordering as Column expressions."""
