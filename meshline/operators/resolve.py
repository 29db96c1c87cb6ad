"""Reference binding, change detection and delta application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_keys(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, node_id): binding keys and aliases of the given nodes; a node that answers twice to a key counts once."""
    own = nodes.where("binding_key is not null").select(F.col("binding_key").alias("key"), F.col("id").alias("node_id"))
    more = aliases.where("binding_key is not null").select(F.col("binding_key").alias("key"), "node_id").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return own.unionByName(more).distinct()


def bind(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(ref_id, target, key, reason): each ref walks its candidate keys in order.

    The first key that any node answers to decides: one node binds, several are
    ambiguous and block the later keys. Keys are counted per key before the
    join, so a key of many nodes is one row. Refs without a match keep their own
    reason, or "no matching binding".
    """
    claims = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    asked = refs.select(F.col("id").alias("ref_id"), F.posexplode("candidate_keys").alias("priority", "key")).where("key is not null")
    hit = asked.join(claims, "key").groupBy("ref_id").agg(F.min(F.struct("priority", "key", "n", "node_id")).alias("h"))
    out = refs.select(F.col("id").alias("ref_id"), F.col("reason").alias("own")).join(hit, "ref_id", "left")
    own = F.coalesce(F.nullif("own", F.lit("")), F.lit("no matching binding"))
    return out.select("ref_id", F.when(F.col("h.n") == 1, F.col("h.node_id")).alias("target"), F.col("h.key").alias("key"), F.when(F.col("h").isNull(), own).when(F.col("h.n") == 1, F.lit("")).otherwise(F.concat(F.lit("ambiguous binding: "), F.col("h.key"))).alias("reason"))


def reference_edges(refs: DataFrame, bound: DataFrame) -> DataFrame:
    """Edges of the bound refs, in the edge layout."""
    return refs.join(bound.where("target is not null").select(F.col("ref_id").alias("id"), "target"), "id").select(F.concat(F.lit("reference:"), "id").alias("id"), "source", "target", F.lower(F.trim("relation")).alias("relation"), F.lit(True).alias("directed"), "file", "line", F.lit("statically_resolved").alias("confidence"), F.to_json(F.struct(F.col("id").alias("reference_id"))).alias("metadata"), F.col("id").alias("ref_id"))


def rebind(refs: DataFrame, old: DataFrame, keys: DataFrame, changed: DataFrame) -> DataFrame:
    """``bind`` after a change: only refs that name a ``changed`` key are bound anew, the others keep ``old``."""
    touched = refs.select("id", F.explode("candidate_keys").alias("key")).join(changed.select("key").distinct(), "key", "left_semi").select("id").distinct()
    fresh = bind(refs.join(touched, "id", "left_semi"), keys)
    kept = old.join(touched.withColumnRenamed("id", "ref_id"), "ref_id", "left_anti").join(refs.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")
    return fresh.unionByName(kept)


def digest(df: DataFrame, columns: list[str]) -> Column:
    """Digest of a row's columns, for equality between generations."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change_detection(old: DataFrame, new: DataFrame, key: str = "path", stamp: str = "hash") -> DataFrame:
    """(key, change): added, changed, deleted or unchanged between two stamp tables."""
    o, n = old.select(key, F.col(stamp).alias("o"), F.lit(True).alias("had")), new.select(key, F.col(stamp).alias("n"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, change.alias("change"))


def apply_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the ``files`` (file) were replaced or deleted.

    Rows owned by those files give way to the new ones. Edges of other files
    into a replaced node stay if the node still exists, and go otherwise.
    """
    gone = files.select("file").distinct()
    kept = nodes.join(gone, "file", "left_anti").unionByName(new_nodes.join(gone, "file", "left_semi"))
    all_edges = edges.join(gone, "file", "left_anti").unionByName(new_edges.join(gone, "file", "left_semi"))
    ids = kept.select("id")
    whole = all_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, whole.select(*edges.columns)


def semantic_losses(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, n_old, n_new): files whose number of inferred edges falls from one generation to the next."""
    inferred = lambda df, n: df.where(F.upper("confidence") == "INFERRED").groupBy("file").agg(F.count("*").alias(n))
    return inferred(old, "n_old").join(inferred(new, "n_new"), "file", "left").na.fill(0, ["n_new"]).where("n_new < n_old")


def generation_slice(df: DataFrame, key: str, upto: int, columns: list[str]) -> DataFrame:
    """The rows that were current when ``upto`` was the last generation."""
    from meshline.tables import current_rows

    return current_rows(df.where(F.col("generation") <= upto), key, ["generation", *columns])
