"""Relational operators: functions from DataFrames to DataFrames, without an action inside."""
