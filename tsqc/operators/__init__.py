"""Operators: each takes long tables (station, variable, ts, value) and returns DataFrames."""
