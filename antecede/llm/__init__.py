"""Operators for cleaning and tokenising training text; nothing else in the library imports them."""
