"""Queries of the general data problems (core package)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import heavy_keys as hk
from meshline.operators import hierarchy as hi
from meshline.operators import orphans as orp
from meshline.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orp.orphan_references(table(spark, d, "refs"), table(spark, d, "nodes"), table(spark, d, "node_aliases"), table(spark, d, "stubs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_id", "field", "ref_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orp.orphan_report(_orphans(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hi.containment_links(table(spark, d, "edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hi.roots_and_depths(_links(spark, d), hi.file_locality)


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    links = hi.cut(_links(spark, d))
    depths = hi.cut(hi.roots_and_depths(links, hi.file_locality))
    return hi.full_paths(depths, hi.ancestor_pairs(links, depths))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    links = hi.cut(_links(spark, d))
    depths = hi.cut(hi.roots_and_depths(links, hi.file_locality))
    return hi.ancestor_pairs(links, depths).where("distance > 0").select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("descendant_id"), "distance")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    return hk.heavy_keys(hk.tree_aggregate(edges, ["relation", "target"], "source", "generation"), ["relation", "target"], edges.count())


def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    per_key = hk.tree_aggregate(table(spark, d, "edges"), ["relation", "target"], "source", "generation")
    return per_key.select("relation", "target", "n_rows", F.col("n_distinct").alias("n_sources"), F.col("last").alias("last_generation"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_hierarchy, p2_descendants, p4_found, p4_per_key)}

_CURRENT_REFS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC, indexed_at DESC) AS rn FROM refs) WHERE rn = 1"
_ORPHANS = f"""
WITH cr AS ({_CURRENT_REFS}),
cn AS (SELECT id, deleted, binding_key, since FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC, indexed_at DESC) AS rn, min(generation) OVER (PARTITION BY id) AS since FROM nodes) WHERE rn = 1),
live AS (SELECT id, binding_key, since FROM cn WHERE NOT coalesce(deleted, false) UNION ALL SELECT id, binding_key, generation FROM stubs),
claims AS (SELECT binding_key AS key, since FROM live WHERE binding_key IS NOT NULL UNION ALL SELECT a.binding_key, l.since FROM node_aliases a JOIN live l ON a.node_id = l.id),
idk AS (SELECT id AS key, min(since) AS since FROM live GROUP BY 1),
bk AS (SELECT key, min(since) AS since FROM claims GROUP BY 1),
vals AS (SELECT id AS ref_id, generation, indexed_at, 'source' AS field, source AS ref_key FROM cr
  UNION ALL SELECT id, generation, indexed_at, 'resolved_target', resolved_target FROM cr
  UNION ALL SELECT id, generation, indexed_at, 'candidate_keys', unnest(candidate_keys) FROM cr),
orphans AS (SELECT DISTINCT v.ref_id, v.field, v.ref_key, v.indexed_at FROM vals v
  LEFT JOIN idk i ON v.field <> 'candidate_keys' AND i.key = v.ref_key AND i.since <= v.generation
  LEFT JOIN bk b ON v.field = 'candidate_keys' AND b.key = v.ref_key AND b.since <= v.generation
  WHERE v.ref_key IS NOT NULL AND i.key IS NULL AND b.key IS NULL)
"""
_LINKS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges) WHERE rn = 1),
links AS (SELECT target AS child, min(source) AS parent FROM cur WHERE lower(trim(relation)) IN ('contains', 'defines', 'method') GROUP BY 1),
ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
walk AS (SELECT id AS node_id, id AS up_id, 0 AS d FROM ids UNION ALL SELECT w.node_id, l.parent, w.d + 1 FROM walk w JOIN links l ON l.child = w.up_id WHERE w.d < 400)
"""
ORACLES = {
    "p1_found": _ORPHANS + "SELECT ref_id, field, ref_key FROM orphans",
    "p1_report": _ORPHANS + "SELECT parent_table, month, CAST(sum(n) AS BIGINT) AS n_orphans, count(*) AS n_refs FROM (SELECT CASE WHEN field = 'candidate_keys' THEN 'node_aliases' ELSE 'nodes' END AS parent_table, strftime(indexed_at, '%Y-%m') AS month, ref_id, count(*) AS n FROM orphans GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "p2_found": f"WITH RECURSIVE {_LINKS}, top AS (SELECT node_id, up_id, d FROM walk WHERE up_id NOT IN (SELECT child FROM links)) SELECT i.id AS node_id, coalesce(t.up_id, '') AS root_id, CAST(coalesce(t.d, -1) AS INTEGER) AS depth FROM ids i LEFT JOIN top t ON t.node_id = i.id",
    "p2_hierarchy": f"WITH RECURSIVE {_LINKS}, top AS (SELECT node_id, up_id, d FROM walk WHERE up_id NOT IN (SELECT child FROM links)), up AS (SELECT w.* FROM walk w WHERE w.node_id IN (SELECT node_id FROM top)), path AS (SELECT node_id, list(up_id ORDER BY d DESC) AS path FROM up GROUP BY 1), below AS (SELECT up_id AS node_id, count(*) - 1 AS n_descendants FROM up GROUP BY 1) SELECT i.id AS node_id, coalesce(t.up_id, '') AS root_id, CAST(coalesce(t.d, -1) AS INTEGER) AS depth, p.path, b.n_descendants FROM ids i LEFT JOIN top t ON t.node_id = i.id LEFT JOIN path p ON p.node_id = i.id LEFT JOIN below b ON b.node_id = i.id",
    "p2_descendants": f"WITH RECURSIVE {_LINKS}, top AS (SELECT node_id FROM walk WHERE up_id NOT IN (SELECT child FROM links)) SELECT w.up_id AS node_id, w.node_id AS descendant_id, CAST(w.d AS INTEGER) AS distance FROM walk w WHERE w.d > 0 AND w.node_id IN (SELECT node_id FROM top)",
    "p4_found": "SELECT relation, target FROM edges GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p4_per_key": "SELECT relation, target, count(*) AS n_rows, count(DISTINCT source) AS n_sources, max(generation) AS last_generation FROM edges GROUP BY 1, 2",
}
