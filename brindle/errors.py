"""Errors with a stable code, turned into ``{"error": ...}`` answers by the engine."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def invalid_filter(message: str) -> QueryError:
    return QueryError("INVALID_FILTER", message)


def invalid_column(name: object) -> QueryError:
    return QueryError("INVALID_COLUMN", f"no column {name!r}")
