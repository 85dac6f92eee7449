"""Operators over DataFrames: intervals, turns, statistics, roles, assembly and evaluation."""
