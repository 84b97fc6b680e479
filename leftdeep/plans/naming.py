"""Columns of a chain are flat and named ``alias__column``."""

from __future__ import annotations

SEPARATOR = "__"


def full_name(alias: str, column: str) -> str:
    return f"{alias}{SEPARATOR}{column}"


def split_name(name: str) -> tuple[str, str]:
    """(alias, column); a name without a separator has the alias ``""``."""
    alias, found, column = name.partition(SEPARATOR)
    return (alias, column) if found else ("", name)


def printable(name: str) -> str:
    alias, column = split_name(name)
    return f"{column} [{alias}]"
