"""Operators: functions from DataFrames to DataFrames. Those that go in rounds, and those that cut a side into blocks by its count, run actions; their docstrings or the README say so."""
