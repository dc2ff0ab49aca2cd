"""Importing this module registers every check."""

from checks import expressions, indexes, live, reports, sequences, state, tables  # noqa: F401
