"""Current rows of tables that keep several index generations per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per ``key``: the columns of the row with the highest ``generation``.

    A maximum over a struct combines on the map side, so a key that holds a
    third of all rows sends one partial row per task instead of its rows.
    Equal generations fall back to the order of the remaining columns, which
    makes the choice the same on every run. Rows whose key is null are dropped.
    ``extra`` adds further aggregates over all generations of the key.
    """
    order = ["generation", *[c for c in columns if c != "generation"]]
    picked = F.max(F.struct(*[F.col(c) for c in order])).alias("_row")
    more = [c.alias(n) for n, c in (extra or {}).items()]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(picked, *more)
    return out.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns if c != key], *(extra or {}))
