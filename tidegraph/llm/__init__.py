"""Operators for preparing training text and large numeric columns; nothing outside this subpackage imports it."""
