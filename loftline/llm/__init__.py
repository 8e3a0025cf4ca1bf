"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Each operator module takes and
returns DataFrames; ``queries`` holds the registered queries and their SQL.
"""
