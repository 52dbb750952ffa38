"""Operators on DataFrames: access paths, predicates, changes, statistics, joins over time and ranges."""
