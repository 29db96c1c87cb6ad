"""Saved answers: what their sources are worth today, and how the nodes they cite stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.operators.feedback import decayed_scores

_DIGEST = "^[0-9a-f]{64}$"


def save_records(events: DataFrame, nodes: DataFrame, sources: DataFrame, identity: str | None) -> DataFrame:
    """(event_id, at, outcome, node_id, file, node_hash, saved_index, saved_disk, saved_identity): a row per event and cited node.

    ``nodes`` is (node_id, file, node_hash), ``sources`` (file, index_hash,
    disk_hash), both as of now: what a later status is held against. An event
    without an id, or with an outcome beyond useful, dead_end and corrected, is
    an error; a cited node that does not exist is kept without evidence.
    """
    known = F.col("outcome").isNull() | F.col("outcome").isin("useful", "dead_end", "corrected")
    bad = F.when(F.col("event_id").isNull() | ~known, F.raise_error(F.concat(F.lit("no valid event: "), F.coalesce(F.col("event_id").cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    each = events.where(bad).select("event_id", "at", "outcome", F.explode(F.array_distinct("nodes")).alias("node_id")).where("node_id is not null")
    held = nodes.join(sources.select("file", F.col("index_hash").alias("saved_index"), F.col("disk_hash").alias("saved_disk")), "file", "left")
    return each.join(held, "node_id", "left").select("event_id", "at", "outcome", "node_id", "file", "node_hash", "saved_index", "saved_disk", F.lit(identity).cast("string").alias("saved_identity"))


def _valid(column: str) -> Column:
    return F.when(F.col(column).rlike(_DIGEST), F.col(column))


def source_status(saved: DataFrame, nodes: DataFrame, sources: DataFrame, identity: str | None) -> DataFrame:
    """(event_id, node_id, at, outcome, status): what each saved row's evidence says today, the first reason that holds.

    A difference between disk and index at the time of saving counts for good. A
    record is current only if its own digests, the index's and the disk's are all
    the same; digests that are no SHA-256 count as missing.
    """
    now = nodes.groupBy("node_id").agg(F.count("*").alias("n_now"), F.min("file").alias("file_now"), F.min("node_hash").alias("hash_now"))
    held = sources.select(F.col("file").alias("file_now"), F.col("index_hash").alias("index_now"), F.col("disk_hash").alias("disk_now"))
    x = saved.join(now, "node_id", "left").join(held, "file_now", "left")
    x = x.withColumns({c: _valid(c) for c in ("saved_disk", "saved_index", "disk_now")})
    status = (
        F.when(F.col("saved_disk") != F.col("saved_index"), "stale (source differed from indexed bytes when saved)")
        .when(F.col("n_now").isNull(), "stale (node missing)").when(F.col("n_now") > 1, "stale (ambiguous node ID)")
        .when(F.col("node_hash").isNull(), "unverified (no saved source fingerprint)")
        .when(F.col("saved_identity").isNotNull() & ~F.col("saved_identity").eqNullSafe(F.lit(identity)), "stale (graph identity changed)")
        .when(~F.col("file").eqNullSafe(F.col("file_now")), "stale (source path changed)").when(~F.col("node_hash").eqNullSafe(F.col("hash_now")), "stale (node changed)")
        .when(F.col("saved_index") != F.col("index_now"), "stale (indexed source changed)").when(F.col("saved_disk") != F.col("disk_now"), "stale (source changed)")
        .when(F.col("saved_disk").isNotNull() & F.col("disk_now").isNull(), "stale (source unavailable)").when(F.col("saved_disk").isNull(), "unverified (source fingerprint unavailable)")
        .when(F.col("saved_identity").isNull(), "unverified (graph identity unavailable)")
        .when((F.col("saved_disk") == F.col("saved_index")) & (F.col("saved_index") == F.col("index_now")) & (F.col("index_now") == F.col("disk_now")), "current")
        .otherwise("unverified (unchanged since save; snapshot/source correspondence unknown)")
    )
    return x.select("event_id", "node_id", "at", "outcome", status.alias("status"))


def classified(status: DataFrame, now: int, half_life_days: float = 30.0, min_corroboration: int = 1) -> DataFrame:
    """(node_id, class, score, positive, negative, verified, stale): how each cited node stands, the first class that holds.

    Stale rows, rows after ``now`` and rows without an outcome score nothing.
    """
    live = ~F.startswith("status", F.lit("stale")) & (F.col("at") <= now) & F.col("outcome").isNotNull()
    useful = F.col("outcome") == "useful"
    per = status.groupBy("node_id").agg(
        F.count_if(live & useful).alias("positive"), F.count_if(live & ~useful).alias("negative"), F.count_if(live & useful & (F.col("status") == "current")).alias("verified"),
        F.count_if(live & (F.col("outcome") == "corrected")).alias("_corrected"), F.count_if(F.startswith("status", F.lit("stale"))).alias("stale"),
    )
    events = status.select("event_id", "at", F.when(live, F.col("outcome")).alias("outcome"), F.array("node_id").alias("nodes"))
    scores = decayed_scores(events, now, half_life_days).select("node_id", "score")
    kind = (
        F.when((F.col("positive") > 0) & (F.col("negative") > 0), "contested").when(F.col("verified") >= min_corroboration, "preferred").when(F.col("positive") > 0, "tentative")
        .when(F.col("_corrected") > 0, "corrected").when(F.col("negative") > 0, "dead_end").when(F.col("stale") > 0, "stale").otherwise("unmarked")
    )
    return per.join(scores, "node_id").select("node_id", kind.alias("class"), "score", "positive", "negative", "verified", "stale")


def overlay(nodes: DataFrame, classes: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(id, annotation): what is known of the given (pos, id) as JSON, in their order and as long as the bytes last.

    Unmarked nodes have no annotation. With a bound, an annotation is kept if it
    and all before it fit.
    """
    from pyspark.sql import Window

    x = nodes.join(classes.where("class <> 'unmarked'").withColumnRenamed("node_id", "id"), "id").select("pos", "id", F.to_json(F.struct("class", "score", "positive", "negative", "verified", "stale")).alias("annotation"))
    if most_bytes is not None:  # the nodes of one answer, at most some hundreds
        x = x.withColumn("_used", F.sum(F.octet_length("annotation") + 1).over(Window.orderBy("pos"))).where(F.col("_used") <= most_bytes)
    return x.select("id", "annotation")
