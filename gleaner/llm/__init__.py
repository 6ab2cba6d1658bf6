"""Operators that prepare a text corpus for model training; nothing outside this package imports it."""
