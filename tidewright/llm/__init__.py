"""Operators for preparing training text; queries and their SQL are in ``queries``."""
