"""Working columns that cannot clash with a user's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(names: str, *tables: DataFrame) -> list[str]:
    """Each of the blank-separated names, with as many underscores before it as no column of ``tables`` has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names.split()]
