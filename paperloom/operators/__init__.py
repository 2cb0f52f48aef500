"""Operators on tables: chunking, column rules, joins and windows, evaluation, packages."""
