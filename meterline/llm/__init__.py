"""Operators for preparing training text at corpus scale.

Every operator takes DataFrames and returns DataFrames.  Nothing else in the
library imports this subpackage; ``queries`` holds the registered queries.
"""
