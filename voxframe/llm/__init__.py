"""Operators for preparing training text: near copies, filters, scores, sampling and tokens.

Each operator takes DataFrames and column names and selects only the columns it needs, so further columns,
whatever their names, never matter. Each module names the defined results for nulls, empty texts and ties.
"""
