"""Operators for preparing training text at cluster scale.

Nothing outside this folder imports it.  Every operator is a function from
DataFrames to a DataFrame; ``registry`` lists the queries and their SQL.
"""
