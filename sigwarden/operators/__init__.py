"""Audit operators: functions of DataFrames with column names as parameters."""
