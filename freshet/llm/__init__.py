"""Operators for preparing training text, their queries and SQL. Nothing outside this folder imports it."""
