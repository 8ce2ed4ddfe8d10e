"""Functions, Column to Column."""
