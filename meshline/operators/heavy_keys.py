"""Per-key results when a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
CHUNK_ROWS = 65_536


def tree_aggregate(edges: DataFrame, keys: list[str], member: str, order: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(keys..., n_rows, n_distinct, last): row count, distinct ``member`` values and highest ``order`` of every key.

    1. Input is combined locally: a task folds its own rows per (key, member),
       so a hot key sends at most one state per distinct member and task.
    2. States go to leaves, one leaf for at most about ``chunk_rows`` input
       rows; the leaf is a hash of the member, so the member sets of two leaves
       are disjoint and their distinct counts add up exactly.
    3. Leaves merge in rounds: ``leaf // fan_in`` until one state per key is
       left. No reducer receives more than ``fan_in`` states of a key.

    The number of rounds is ``log_fan_in`` of the leaf count, from the row
    count alone, so it is the same plan for even and for skewed keys. Null keys
    form a group of their own, null members are not counted as distinct, a null
    order is ignored; an empty table gives no row.
    """
    leaves = fan_in ** max(1, math.ceil(math.log(max(2, edges.count() / chunk_rows), fan_in)))
    state = edges.groupBy(*keys, member).agg(F.count("*").alias("n_rows"), F.max(order).alias("last"))
    leaf = F.pmod(F.xxhash64(F.col(member)), F.lit(leaves)).cast("int").alias("leaf")
    state = state.groupBy(*keys, leaf).agg(F.sum("n_rows").alias("n_rows"), F.count(member).alias("n_distinct"), F.max("last").alias("last"))
    width = leaves
    while width > 1:
        width //= fan_in
        up = [F.floor(F.col("leaf") / fan_in).cast("int").alias("leaf")] if width > 1 else []
        state = state.groupBy(*keys, *up).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"), F.max("last").alias("last"))
    return state


def heavy_keys(per_key: DataFrame, keys: list[str], total: int, share: float = 0.01) -> DataFrame:
    """Keys whose ``n_rows`` is at least ``share`` of ``total``: at most ``1 / share`` rows."""
    return per_key.where((F.col("n_rows") >= F.lit(share) * F.lit(total)) & F.lit(total > 0)).select(*keys)
