"""Operators for preparing training text. Each takes and returns DataFrames.

Task code is sent to the executors by value: they need the listed libraries, but not this package.
"""
