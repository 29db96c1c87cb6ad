"""Queries of unranked lookups, bounds and saved answers with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import lookup as lk
from meshline.operators import memory as mem
from meshline.operators import metrics as m
from meshline.operators.graph import SQL, current_graph
from meshline.plans.analysis import _POST
from meshline.plans.exchange import NOW
from meshline.plans.navigation import current_refs
from meshline.session import table
from meshline.tables import current_rows

TEXTS = ["packet", "fold cursor", "corelog", "zzzz nothing"]
SHORTHANDS = ["call", "CALLS ", "import", "con", "e", "no such relation"]
IDENTITY = "one"


def t6_basic_search(spark: SparkSession, d: str) -> DataFrame:
    return lk.basic_search(current_graph(spark, d).nodes, TEXTS)


def t11_file_roots(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return lk.file_roots(g.nodes, g.nodes.select("file").unionByName(table(spark, d, "files").select(F.col("path").alias("file"))))


def t13_shorthand(spark: SparkSession, d: str) -> DataFrame:
    """Every shorthand at every class."""
    g = current_graph(spark, d)
    asked = g.nodes.where("kind = 'class'").select("id", F.explode(F.array(*map(F.lit, SHORTHANDS))).alias("text"))
    return lk.resolve_relations(asked, lk.incident_relations(g, current_refs(spark, d)))


def s4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bytes of identifiers and names of a snapshot, which a bounded one is held against before it is made."""
    return m.snapshot_sizes(current_graph(spark, d), current_refs(spark, d))


def _saved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved rows out of memory and issue documents that cite a file, held against the file's first generation; and what is so now."""
    files = table(spark, d, "files").where("path is not null")
    first = files.groupBy("path").agg(F.min(F.struct("generation", "hash", "module")).alias("f"))
    held = first.select(F.col("path").alias("node_id"), F.col("path").alias("file"), F.sha2(F.coalesce("f.module", F.lit("")), 256).alias("node_hash"))
    was = first.select(F.col("path").alias("file"), F.sha2("f.hash", 256).alias("index_hash"), F.sha2("f.hash", 256).alias("disk_hash"))
    cur = current_rows(files, "path", ["generation", "hash", "module", "content"])
    nodes = cur.select(F.col("path").alias("node_id"), F.col("path").alias("file"), F.sha2(F.coalesce("module", F.lit("")), 256).alias("node_hash"))
    sources = cur.select(F.col("path").alias("file"), F.sha2("hash", 256).alias("index_hash"), F.when(F.col("content").isNotNull(), F.sha2("hash", 256)).alias("disk_hash"))
    docs = table(spark, d, "documents").where("source in ('memory', 'issue') and doc_id is not null and path is not null")
    outcome = F.when(F.col("doc_id") % 4 == 0, "useful").when(F.col("doc_id") % 4 == 1, "dead_end").when(F.col("doc_id") % 4 == 2, "corrected")
    events = docs.select(F.col("doc_id").alias("event_id"), F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("at"), outcome.alias("outcome"), F.array("path").alias("nodes"))
    return mem.save_records(events, held, was, IDENTITY), nodes, sources


def m1_saved(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d)[0].select("event_id", "node_id", "outcome", "saved_index", "saved_identity")


def m2_source_status(spark: SparkSession, d: str) -> DataFrame:
    return mem.source_status(*_saved(spark, d), IDENTITY).select("event_id", "node_id", "status")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return mem.classified(mem.source_status(*_saved(spark, d), IDENTITY), NOW)


def m4_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("node_id", "class", "positive", "negative", "verified", "stale")


def m8_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Files whose nodes are annotated, with their class."""
    nodes = table(spark, d, "files").select(F.col("path").alias("id")).distinct().withColumn("pos", F.lit(0))
    return mem.overlay(nodes, _classes(spark, d)).select("id", F.get_json_object("annotation", "$.class").alias("class"))


QUERIES = {f.__name__: f for f in (t6_basic_search, t11_file_roots, t13_shorthand, s4_bounds, m1_saved, m2_source_status, m4_classes, m8_overlay)}

WITH = f"WITH {SQL}"
_TERMS = ", ".join(f"('{q}', '{t}')" for q in TEXTS for t in q.split())
_HANDS = ", ".join(f"('{t}')" for t in SHORTHANDS)
_BYTES = "CAST(sum({}) AS BIGINT)"
_LEN = lambda *cs: " + ".join(f"coalesce(strlen({c}), 0)" for c in cs)
_OLD = "old AS (SELECT path, hash, module FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation, hash, module) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1), cur AS (SELECT path, hash, module, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation DESC) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1), ev AS (SELECT doc_id AS event_id, epoch(created_at)::BIGINT AS ts, CASE doc_id % 4 WHEN 0 THEN 'useful' WHEN 1 THEN 'dead_end' WHEN 2 THEN 'corrected' END AS outcome, path AS node_id FROM documents WHERE source IN ('memory', 'issue') AND path IS NOT NULL)"
_STATUS = _OLD + ", st AS (SELECT e.*, CASE WHEN c.path IS NULL THEN 'stale (node missing)' WHEN o.path IS NULL THEN 'unverified (no saved source fingerprint)' WHEN coalesce(o.module, '') <> coalesce(c.module, '') THEN 'stale (node changed)' WHEN o.hash <> c.hash THEN 'stale (indexed source changed)' WHEN o.hash IS NOT NULL AND (c.content IS NULL OR c.hash IS NULL) THEN 'stale (source unavailable)' WHEN o.hash IS NULL THEN 'unverified (source fingerprint unavailable)' ELSE 'current' END AS status FROM ev e LEFT JOIN old o ON o.path = e.node_id LEFT JOIN cur c ON c.path = e.node_id)"
_CLASS = _STATUS + f", n AS (SELECT node_id, count(*) FILTER (WHERE live AND outcome = 'useful') AS positive, count(*) FILTER (WHERE live AND outcome <> 'useful') AS negative, count(*) FILTER (WHERE live AND outcome = 'useful' AND status = 'current') AS verified, count(*) FILTER (WHERE live AND outcome = 'corrected') AS corrected, count(*) FILTER (WHERE status LIKE 'stale%') AS stale FROM (SELECT *, status NOT LIKE 'stale%' AND ts <= {NOW} AND outcome IS NOT NULL AS live FROM st) GROUP BY 1), cl AS (SELECT node_id, CASE WHEN positive > 0 AND negative > 0 THEN 'contested' WHEN verified >= 1 THEN 'preferred' WHEN positive > 0 THEN 'tentative' WHEN corrected > 0 THEN 'corrected' WHEN negative > 0 THEN 'dead_end' WHEN stale > 0 THEN 'stale' ELSE 'unmarked' END AS class, positive, negative, verified, stale FROM n)"
ORACLES = {
    "t6_basic_search": WITH + _POST + f", qt(query, term) AS (VALUES {_TERMS}), ex AS (SELECT DISTINCT query, id FROM (SELECT DISTINCT query FROM qt) JOIN gn ON id = query OR label = query OR qualified_name = query OR file = query), h AS (SELECT DISTINCT q.query, p.id FROM qt q JOIN post p ON starts_with(p.token, q.term) WHERE q.query NOT IN (SELECT query FROM ex) UNION ALL SELECT * FROM ex) SELECT query, pos - 1 AS pos, id, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS pos, count(*) OVER (PARTITION BY query) AS n FROM h) WHERE pos <= 20",
    "t11_file_roots": WITH + ", a AS (SELECT file FROM gn WHERE file IS NOT NULL UNION SELECT path FROM files WHERE path IS NOT NULL), r AS (SELECT file, id, coalesce(kind IN ('file', 'module') OR (line = 1 AND label = regexp_extract(file, '[^/]*$')), false) AS root FROM gn WHERE file IS NOT NULL), p AS (SELECT file, count(*) AS n_nodes, count(*) FILTER (WHERE root) AS n_roots, min(id) FILTER (WHERE root) AS rid, min(id) AS oid FROM r GROUP BY 1) SELECT a.file, CASE WHEN n_roots = 1 THEN rid WHEN n_roots = 0 AND n_nodes = 1 THEN oid END AS id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_roots, 0) AS n_roots FROM a LEFT JOIN p USING (file)",
    "t13_shorthand": WITH + f", i AS (SELECT source AS id, relation FROM ge UNION SELECT target, relation FROM ge UNION SELECT source, relation FROM gr WHERE resolved_target IS NULL AND relation IS NOT NULL AND source IS NOT NULL), q AS (SELECT id, text FROM gn, (VALUES {_HANDS}) v(text) WHERE kind = 'class'), h AS (SELECT q.id, text, relation, CASE WHEN relation = text THEN 0 WHEN lower(relation) = lower(trim(text)) THEN 1 WHEN starts_with(lower(relation), lower(trim(text))) THEN 2 WHEN contains(lower(relation), lower(trim(text))) THEN 3 END AS tier FROM q JOIN i USING (id)), p AS (SELECT id, text, tier, count(*) AS n, min(relation) AS r, row_number() OVER (PARTITION BY id, text ORDER BY tier) AS rn FROM h WHERE tier IS NOT NULL GROUP BY 1, 2, 3) SELECT q.id, q.text, CASE WHEN p.id IS NULL THEN q.text WHEN n = 1 THEN r END AS relation, coalesce(n, 0) AS n FROM q LEFT JOIN p ON p.id = q.id AND p.text = q.text AND rn = 1",
    "s4_bounds": WITH + f" SELECT 'nodes' AS record, count(*) AS n_rows, {_BYTES.format(_LEN('id', 'label', 'qualified_name', 'file', 'metadata'))} AS n_bytes FROM gn UNION ALL SELECT 'edges', count(*), {_BYTES.format(_LEN('id', 'source', 'target', 'relation', 'metadata'))} FROM ge UNION ALL SELECT 'refs', count(*), {_BYTES.format(_LEN('id', 'source', 'label', 'relation'))} FROM gr",
    "m1_saved": f"WITH {_OLD} SELECT e.event_id, e.node_id, e.outcome, CASE WHEN o.hash IS NOT NULL THEN sha256(o.hash) END AS saved_index, '{IDENTITY}' AS saved_identity FROM ev e LEFT JOIN old o ON o.path = e.node_id",
    "m2_source_status": f"WITH {_STATUS} SELECT event_id, node_id, status FROM st",
    "m4_classes": f"WITH {_CLASS} SELECT node_id, class, positive, negative, verified, stale FROM cl",
    "m8_overlay": f"WITH {_CLASS} SELECT node_id AS id, class FROM cl WHERE class <> 'unmarked' AND node_id IN (SELECT path FROM files)",
}
