"""Operators for preparing training text: one module per operator, queries and SQL in ``queries``."""
