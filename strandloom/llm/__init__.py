"""Operators for preparing training text, each in its own module, and their registered queries."""
