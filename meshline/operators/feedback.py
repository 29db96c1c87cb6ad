"""Feedback events with decay, and the data side of a review queue: file impact and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def end_of_day(seconds: int) -> int:
    """The last second of the UTC day."""
    return seconds - seconds % DAY + DAY - 1


def parse_utc(column):
    """Seconds of a strict ``YYYY-MM-DDTHH:MM:SSZ``; anything else, a day that is none included, is null."""
    strict = F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), column)
    return F.unix_timestamp(F.try_to_timestamp(strict, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def decayed_scores(events: DataFrame, now: int, half_life_days: float = 30.0) -> DataFrame:
    """(node_id, score, useful, negative, future) from (event_id, at, outcome, nodes).

    A node counts once per event; events after ``now`` and without an outcome
    score nothing; weight is 2^(-days/half_life), 1 for a half-life of 0.
    """
    if half_life_days < 0:
        raise ValueError("half-life must be at least 0")
    each = events.select("event_id", "at", "outcome", F.explode(F.array_distinct("nodes")).alias("node_id")).where("node_id is not null")
    age = (F.lit(now) - F.col("at")) / F.lit(float(DAY))
    weight = F.lit(1.0) if half_life_days == 0 else F.pow(F.lit(2.0), -age / F.lit(half_life_days))
    counted = F.col("outcome").isNotNull() & (F.col("at") <= now)
    good = F.col("outcome") == "useful"
    per = each.groupBy("node_id").agg(
        F.round(F.coalesce(F.sum(F.when(counted, F.when(good, weight).otherwise(-weight))), F.lit(0.0)), 9).alias("score"),
        F.count_if(counted & good).alias("useful"), F.count_if(counted & ~good).alias("negative"), F.count_if(F.col("at") > now).alias("future"),
    )
    return per


def unique_labels(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(citation, node_id): a citation that is no id binds to the node of that label if there is exactly one."""
    ids = nodes.select(F.col("id").alias("citation"), F.col("id").alias("node_id"))
    by_id = citations.join(ids, "citation")
    single = nodes.groupBy(F.col("label").alias("citation")).agg(F.count("*").alias("n"), F.min("id").alias("node_id")).where("n = 1").drop("n")
    return by_id.unionByName(citations.join(by_id.select("citation"), "citation", "left_anti").join(single, "citation"))


def file_matches(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file, n): files that a changed path names, exactly or as a suffix at a folder boundary.

    An exact match beats suffixes; ``n`` above 1 is ambiguous, 0 unmatched. The
    suffix join runs on the base name, so it stays an equi-join.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    p = paths.select("path", base(F.col("path")).alias("base")).distinct()
    f = files.select("file", base(F.col("file")).alias("base")).distinct()
    hit = p.join(f, "base").where((F.col("file") == F.col("path")) | F.endswith("file", F.concat(F.lit("/"), F.col("path"))))
    best = hit.withColumn("exact", F.col("file") == F.col("path")).groupBy("path").agg(F.max("exact").alias("any_exact"), F.count("*").alias("n_all"), F.min("file").alias("first"))
    n = F.when(F.col("any_exact"), 1).otherwise(F.coalesce("n_all", F.lit(0)))
    out = p.select("path").join(best, "path", "left")
    return out.select("path", F.when(n == 1, F.when(F.col("any_exact"), F.col("path")).otherwise(F.col("first"))).alias("file"), n.cast("bigint").alias("n"))


def overlaps(changes: DataFrame) -> DataFrame:
    """(a, b, n_shared): pairs of changes (change_id, path) that touch the same path, a < b.

    Pairs are made per path, where a change counts once.
    """
    c = changes.distinct()
    return c.select(F.col("change_id").alias("a"), "path").join(c.select(F.col("change_id").alias("b"), "path"), "path").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))
