"""Where queries register themselves, with the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(check: str | None = None):
    """Registers a query (spark, sf_dir) under its name; ``check``: SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if check:
            SQL[f.__name__] = check
        return f

    return add
