"""Names for helper columns that no column of the caller has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from all in ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def schema_of(df: DataFrame, columns: Iterable[str]) -> str:
    """DDL of some columns of a table."""
    quoted = ((c.replace("`", "``"), df.schema[c].dataType.simpleString()) for c in columns)
    return ", ".join(f"`{c}` {kind}" for c, kind in quoted)
