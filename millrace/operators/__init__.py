"""Operators on DataFrames: validation, votes, duplicates, splits, schedules, joins, batches, statistics."""
