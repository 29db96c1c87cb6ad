"""References to records that do not exist, by bitmaps per key range and period."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.bitmaps import Bitmap
from meshline.tables import current_rows

SURVIVORS = "space int, ref_key string, generation bigint"
SALTS = 8


def live_parents(nodes: DataFrame, aliases: DataFrame, stubs: DataFrame) -> DataFrame:
    """(space, key, since): ids (space 0) and binding keys (space 1) that live records answer to, one row a claim.

    ``since`` is the lowest generation of the record; a record without any
    generation is known from the start.
    """
    cur = current_rows(nodes, "id", ["generation", "deleted", "binding_key"], {"since": F.min("generation")})
    live = cur.where(~F.coalesce("deleted", F.lit(False))).select("id", "binding_key", "since")
    live = live.unionByName(
        stubs.where(F.col("id").isNotNull()).select("id", "binding_key", F.col("generation").alias("since"))
    ).withColumn("since", F.coalesce("since", F.lit(0)).cast("bigint"))
    by_id = live.select(F.lit(0).alias("space"), F.col("id").alias("key"), "since")
    by_key = live.select(F.lit(1).alias("space"), F.col("binding_key").alias("key"), "since")
    names = aliases.where(F.col("binding_key").isNotNull()).select(F.col("node_id").alias("id"), F.col("binding_key").alias("key"))
    by_alias = names.distinct().join(live.select("id", "since"), "id").select(F.lit(1).alias("space"), "key", "since")
    return by_id.unionByName(by_key.where("key is not null")).unionByName(by_alias)


def reference_values(refs: DataFrame) -> DataFrame:
    """(ref_id, indexed_at, generation, field, space, ref_key): each non-null value of the current rows, once.

    Nulls, null lists, empty lists and null elements give no row; a ref whose
    generation is null is taken to know every record.
    """
    cur = current_rows(refs, "id", ["generation", "indexed_at", "source", "resolved_target", "candidate_keys"])
    values = F.array(
        F.struct(F.lit("source").alias("field"), F.lit(0).alias("space"), F.array("source").alias("keys")),
        F.struct(F.lit("resolved_target").alias("field"), F.lit(0).alias("space"), F.array("resolved_target").alias("keys")),
        F.struct(F.lit("candidate_keys").alias("field"), F.lit(1).alias("space"), F.array_distinct("candidate_keys").alias("keys")),
    )
    return (
        cur.select(F.col("id").alias("ref_id"), "indexed_at", F.coalesce("generation", F.lit(2**62)).cast("bigint").alias("generation"), F.explode(values).alias("v"))
        .select("ref_id", "indexed_at", "generation", "v.field", "v.space", F.explode("v.keys").alias("ref_key"))
        .where(F.col("ref_key").isNotNull())
    )


def _surviving(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One key range: AND-NOT the references of each period with the parents known by then, and decode what is left.

    A row has a key, its parents' earliest period (null without one) and the
    periods that refer to it; its place in the range is the key's code.
    """
    since, asked = rows.column("since"), rows.column("asked")
    parents = np.flatnonzero(~np.asarray(since.is_null()))
    p_period = since.drop_null().to_numpy()
    order = np.argsort(p_period, kind="stable")
    parents, p_period = parents[order], p_period[order]
    r_period = asked.flatten().to_numpy()
    r_codes = np.repeat(np.arange(rows.num_rows), np.diff(asked.offsets.to_numpy()))
    known, at, codes, periods = Bitmap(), 0, [], []
    for t in np.unique(r_period):
        upto = int(np.searchsorted(p_period, t, side="right"))
        if upto > at:
            known, at = known | Bitmap.of(parents[at:upto]), upto
        left = Bitmap.of(r_codes[r_period == t]).and_not(known).codes()
        codes.append(left)
        periods.append(np.full(len(left), t))
    found = pa.array(np.concatenate(codes).astype(np.int64) if codes else np.empty(0, np.int64))
    generation = pa.array(np.concatenate(periods).astype(np.int64) if periods else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays([rows.column("space").take(found), rows.column("key").take(found), generation], names=["space", "ref_key", "generation"])


def orphan_references(refs: DataFrame, nodes: DataFrame, aliases: DataFrame, stubs: DataFrame) -> DataFrame:
    """(ref_id, field, ref_key, indexed_at, generation): every value that no live record known to its ref answers to.

    References and parents are brought together by key: a row a key, with the
    earliest period of a parent and the set of periods (index generations) that
    refer to it. Both combine on the map side, so a key held by a third of all
    refs is one short row a task. Any batch of such rows is a key range of its
    own: its keys are dictionary-encoded as dense integers, one compressed bitmap
    per period is built for references and parents, ``reference AND-NOT parents
    so far`` leaves the orphans, and their bits are decoded. The surviving keys,
    salted, then select the refs by a semi join, so that the refs of a hot key go
    to SALTS tasks.

    Empty tables: without refs nothing comes out, without parents every value
    does. Keys are opaque strings, compared exactly; the empty string is a key.
    """
    values = reference_values(refs)
    nothing = F.lit(None).cast("bigint")
    asked = values.select("space", F.col("ref_key").alias("key"), "generation", nothing.alias("since"))
    known = live_parents(nodes, aliases, stubs).select("space", "key", nothing.alias("generation"), "since")
    by_key = asked.unionByName(known).groupBy("space", "key").agg(F.min("since").alias("since"), F.collect_set("generation").alias("asked"))
    left = by_key.where(F.size("asked") > 0).mapInArrow(lambda batches: map(_surviving, batches), SURVIVORS)
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = values.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(SALTS)).cast("int"))
    return salted.join(left, ["space", "ref_key", "generation", "salt"], "left_semi").select("ref_id", "field", "ref_key", "indexed_at", "generation")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(parent_table, month, n_orphans, n_refs): orphan values per table pointed to and month of ``indexed_at``."""
    table = F.when(F.col("field") == "candidate_keys", F.lit("node_aliases")).otherwise(F.lit("nodes"))
    return (
        orphans.select(table.alias("parent_table"), F.date_format("indexed_at", "yyyy-MM").alias("month"), "ref_id")
        .groupBy("parent_table", "month", "ref_id").agg(F.count("*").alias("n"))
        .groupBy("parent_table", "month").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_refs"))
    )
