"""Parent-child rows to full hierarchies: fragment contraction, a smaller quotient forest, expansion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.session import buckets_for, cut
from meshline.tables import current_rows

PER_BUCKET = 60_000
CONTAINMENT = ("contains", "defines", "method")
STATE = "node string, up string, w bigint, root string, cyclic boolean"


def containment_links(edges: DataFrame, relations: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """(child, parent) over current rows whose relation, without case and surrounding blanks, is listed.

    Rows of other relations only take part with their generation. A child with
    several parents keeps the smallest parent id; a self-loop is a link.
    """
    wanted = F.lower(F.trim("relation")).isin(*relations)
    slim = edges.select("id", "generation", F.when(wanted, F.col("source")).alias("source"), F.when(wanted, F.col("target")).alias("target"))
    cur = current_rows(slim, "id", ["generation", "source", "target"])
    return cur.where("source is not null and target is not null").groupBy(F.col("target").alias("child")).agg(F.min("source").alias("parent"))


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow parents inside one bucket to the fragment's exit by pointer doubling.

    Input is one row a node: ``up`` with weight ``w`` if the node still points
    somewhere, else its ``root`` at distance ``w`` or the ``cyclic`` mark. What
    comes out has the same form, with ``up`` now outside the bucket.
    """
    node = pdf["node"].to_numpy(dtype=object)
    up = pdf["up"].to_numpy(dtype=object)
    n = len(node)
    where = pd.Index(node).get_indexer(pd.Index(up))
    where[pdf["up"].isna().to_numpy()] = -1
    here = np.arange(n)
    ptr = np.where(where >= 0, where, here)
    dist = np.where(where >= 0, pdf["w"].to_numpy(), 0).astype(np.int64)
    for _ in range(max(1, n.bit_length())):
        dist = dist + dist[ptr]
        ptr = ptr[ptr]
    end = ptr
    loops = where[end] >= 0
    cyclic = loops | pdf["cyclic"].to_numpy(dtype=bool)[end]
    w = dist + pdf["w"].to_numpy(dtype=np.int64)[end]
    out_up, root = up[end].copy(), pdf["root"].to_numpy(dtype=object)[end].copy()
    out_up[cyclic] = None
    root[cyclic] = None
    return pd.DataFrame({"node": node, "up": out_up, "w": np.where(cyclic, 0, w), "root": root, "cyclic": cyclic})


def _by_bucket(state: DataFrame, key: Column, rows: int) -> DataFrame:
    """Contract in hashed buckets of ``key``; a key of more rows than a bucket is spread by node instead."""
    buckets = 1 if rows <= PER_BUCKET else buckets_for(rows, PER_BUCKET, 2)
    keyed = state.withColumn("k", key)
    if buckets > 1:
        hot = [r["k"] for r in keyed.groupBy("k").count().where(F.col("count") > PER_BUCKET).select("k").collect()]  # at most rows / PER_BUCKET keys
        if hot:
            keyed = keyed.withColumn("k", F.when(F.col("k").isin(hot), F.col("node")).otherwise(F.col("k")))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).drop("k")
    return keyed.groupBy("bucket").applyInPandas(lambda pdf: _contract(pdf), STATE)


def _solve(state: DataFrame, rows: int, key: Column, round_: int = 0) -> DataFrame:
    """Every node with ``root`` and distance ``w``, or ``cyclic``; ``up`` is null throughout."""
    done = cut(_by_bucket(state, key, rows))
    exits = done.where("up is not null").select(F.col("up").alias("node")).distinct()
    quotient = done.join(exits, "node", "left_semi")
    if rows <= PER_BUCKET:
        return done
    quotient = cut(quotient)
    left = quotient.count()
    if left == 0:
        return done
    # A coin per node and round: tails with a heads parent move in with the parent, so chains shrink whatever the ids are.
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(round_)), F.lit(2))
    star = F.when(F.col("up").isNotNull() & (coin("node") == 1) & (coin("up") == 0), F.col("up")).otherwise(F.col("node"))
    solved = _solve(quotient, left, star, round_ + 1).select(F.col("node").alias("up"), F.col("root").alias("q_root"), F.col("w").alias("q_w"), F.col("cyclic").alias("q_cyclic"))
    joined = done.join(solved, "up", "left")
    return joined.select(
        "node", F.lit(None).cast("string").alias("up"),
        F.when(F.col("q_cyclic"), F.lit(0)).otherwise(F.col("w") + F.coalesce("q_w", F.lit(0))).cast("bigint").alias("w"),
        F.coalesce("root", "q_root").alias("root"), (F.col("cyclic") | F.coalesce("q_cyclic", F.lit(False))).alias("cyclic"),
    )


def roots_and_depths(links: DataFrame, locality: Callable[[str], Column] | None = None) -> DataFrame:
    """(node_id, root_id, depth) of every id that is a parent or a child in ``links`` (child, parent).

    Chains are contracted inside buckets to their fragment's exit, the exits
    form a smaller quotient forest that is solved the same way until it fits one
    bucket, and its answers are joined back. ``locality`` maps a column of ids
    to a key that parent and child tend to share (a file, say), which makes the
    quotient small at once; without it, or where a key is too large, ids are
    spread by hash. A cycle inside a bucket is found there, a longer one in the
    quotient. Ids on a cycle or below one have root ``''`` and depth -1.
    Duplicate links count once; an empty table gives no row.
    """
    plain = F.col("parent").alias("up")
    children = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    state = children.select(F.col("child").alias("node"), plain).unionByName(children.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("up")))
    state = state.groupBy("node").agg(F.max("up").alias("up"))
    state = state.select("node", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("bigint").alias("w"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.lit(False).alias("cyclic"))
    state = cut(state)
    key = locality("node") if locality else F.col("node")
    solved = _solve(state, state.count(), F.coalesce(key, F.col("node")))
    return solved.select(F.col("node").alias("node_id"), F.when(F.col("cyclic"), F.lit("")).otherwise(F.col("root")).alias("root_id"), F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("w")).cast("int").alias("depth"))


def file_locality(column: str) -> Column:
    """The file part of ids of the form ``language:file:name``; null where there is none."""
    return F.nullif(F.split_part(F.col(column), F.lit(":"), F.lit(2)), F.lit(""))


def ancestor_pairs(links: DataFrame, depths: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance): every node with each of its ancestors, itself at 0, nodes of cycles left out.

    Ancestor lists double in length each round, so a tree of depth d takes
    log2(d) joins; the size is that of the result.
    """
    sound = depths.where("depth >= 0").select("node_id")
    parent = links.groupBy(F.col("child").alias("node_id")).agg(F.min("parent").alias("ancestor_id")).join(sound, "node_id", "left_semi")
    pairs = cut(parent.select("node_id", "ancestor_id", F.lit(1).alias("distance")))
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach < deepest:
        # rows at the longest distance so far jump over the whole lists of their ancestors
        far = pairs.where(F.col("distance") == reach).select("node_id", F.col("ancestor_id").alias("via"))
        more = pairs.select(F.col("node_id").alias("via"), "ancestor_id", (F.col("distance") + reach).cast("int").alias("distance"))
        pairs = cut(pairs.unionByName(far.join(more, "via").select("node_id", "ancestor_id", "distance")))
        reach *= 2
    return pairs.unionByName(sound.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")))


def full_paths(depths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path, n_descendants) of every node; path and count are null for nodes of cycles.

    ``path`` lists the ids from the root to the node.
    """
    path = pairs.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor_id")), asc=False), lambda s: s["ancestor_id"]).alias("path"))
    below = pairs.groupBy(F.col("ancestor_id").alias("node_id")).agg((F.count("*") - 1).alias("n_descendants"))
    return depths.join(path, "node_id", "left").join(below, "node_id", "left")
