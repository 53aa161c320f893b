"""Operators for building training corpora: ten of them, their queries and SQL.

Nothing outside this subpackage imports it.
"""
