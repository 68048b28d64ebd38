"""Operators: functions from DataFrames to DataFrames, with their parameters explicit."""
