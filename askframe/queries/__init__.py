"""Registered queries: one for each operator, with its SQL where SQL can express it."""
