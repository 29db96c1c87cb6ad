"""Queries of binding, deltas, navigation and streaming refresh with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import metrics as m
from meshline.operators import resolve as r
from meshline.operators import traverse as t
from meshline.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, SQL, current_graph
from meshline.plans.metrics import _INC, NOISE
from meshline.session import table
from meshline.streaming.refresh import Generations, refresh, scratch, stream_table
from meshline.tables import current_rows

REF_COLUMNS = ["generation", "indexed_at", "source", "label", "relation", "file", "line", "candidate_keys", "reason", "resolved_target", "resolution_reason", "repo"]
BASELINE = 24


def current_refs(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "refs"), "id", REF_COLUMNS)


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return r.node_keys(current_graph(spark, d).nodes, table(spark, d, "node_aliases"))


def d2_bind(spark: SparkSession, d: str) -> DataFrame:
    return r.bind(current_refs(spark, d), _keys(spark, d))


def d2_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return d2_bind(spark, d).where("reason like 'ambiguous binding: %'").groupBy("key").agg(F.count("*").alias("n_refs"))


def d2_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    refs = current_refs(spark, d)
    return r.reference_edges(refs, r.bind(refs, _keys(spark, d))).select("id", "source", "target", "relation")


def d2_rebind(spark: SparkSession, d: str) -> DataFrame:
    """Bindings at the baseline generation, rebound for the keys of the nodes that changed since."""
    refs, keys = current_refs(spark, d), _keys(spark, d)
    old_nodes = r.generation_slice(table(spark, d, "nodes"), "id", BASELINE, ["deleted", *NODE_COLUMNS[1:]]).where("not coalesce(deleted, false)").select(*NODE_COLUMNS)
    stubs = table(spark, d, "stubs").select("id", "binding_key")
    old_keys = r.node_keys(old_nodes.unionByName(stubs, allowMissingColumns=True), table(spark, d, "node_aliases"))
    changed = keys.exceptAll(old_keys).unionByName(old_keys.exceptAll(keys)).select("key")
    return r.rebind(refs, r.bind(refs, old_keys), keys, changed)


def d1_changes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return r.change_detection(r.generation_slice(files, "path", BASELINE, ["hash"]), current_rows(files, "path", ["generation", "hash"]))


def _old_nodes(spark: SparkSession, d: str) -> DataFrame:
    return r.generation_slice(table(spark, d, "nodes"), "id", BASELINE, ["deleted", *NODE_COLUMNS[1:]]).where("not coalesce(deleted, false)").select(*NODE_COLUMNS)


def d4_delta(spark: SparkSession, d: str) -> DataFrame:
    changed = d1_changes(spark, d).where("change <> 'unchanged'").select(F.col("path").alias("file"))
    old_edges = r.generation_slice(table(spark, d, "edges"), "id", BASELINE, EDGE_COLUMNS[1:]).select(*EDGE_COLUMNS)
    new_nodes = current_rows(table(spark, d, "nodes"), "id", ["generation", "deleted", *NODE_COLUMNS[1:]]).where("not coalesce(deleted, false)").select(*NODE_COLUMNS)
    new_edges = current_rows(table(spark, d, "edges"), "id", ["generation", *EDGE_COLUMNS[1:]]).select(*EDGE_COLUMNS)
    nodes, edges = r.apply_delta(_old_nodes(spark, d), old_edges, new_nodes, new_edges, changed)
    return nodes.select(F.lit("node").alias("record"), "id").unionByName(edges.select(F.lit("edge").alias("record"), "id"))


def d5_digest(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).nodes.where("file is not null").groupBy("file").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("id"))), 256).alias("digest"))


def d6_bumped(spark: SparkSession, d: str) -> DataFrame:
    """Files whose set of nodes differs between the baseline and now: only those advance a generation."""
    digest = lambda n: n.where("file is not null").groupBy("file").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("id"))), 256).alias("hash"))
    return r.change_detection(digest(_old_nodes(spark, d)), digest(current_graph(spark, d).nodes), "file").where("change <> 'unchanged'")


def d9_losses(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    cols = ["file", "confidence"]
    return r.semantic_losses(r.generation_slice(edges, "id", BASELINE, cols), current_rows(edges, "id", ["generation", *cols]))


def d10_foreign(spark: SparkSession, d: str) -> DataFrame:
    return m.with_ends(current_graph(spark, d), "file").where("file is not null and s_file is not null and file <> s_file").select("id", "file", F.col("s_file").alias("owner"))


def g1_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return t.adjacency(current_graph(spark, d)).select("id", "stream", "edge_id", "other")


def g1_incoming(spark: SparkSession, d: str) -> DataFrame:
    return t.adjacency(current_graph(spark, d), "incoming", ("calls", "uses")).select("id", "stream", "edge_id", "other")


def _of_kind(g, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind).select("id")


def g3_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, ("kind",), ("directed",))
    return t.walk(g, _of_kind(g, "package"), 1, "both")


def g2_walk(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, ("kind",), ("directed",))
    return t.walk(g, _of_kind(g, "package"), 3, "outgoing")


def g4_explore(spark: SparkSession, d: str) -> DataFrame:
    """Bounded exploration from the top hub, with its order."""
    g = current_graph(spark, d)
    seeds = [x["id"] for x in m.hubs(g, 1).collect()]
    found = t.explore(g, seeds, t.Options(depth=2, limit=200))
    return spark.createDataFrame([(i, n, found.depths[n]) for i, n in enumerate(found.nodes)], "pos int, id string, depth int")


def g5_explore_dfs(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    seeds = [x["id"] for x in m.hubs(g, 1).collect()]
    found = t.explore(g, seeds, t.Options(depth=2, limit=60, direction="incoming"), "dfs")
    return spark.createDataFrame([(i, n, found.depths[n]) for i, n in enumerate(found.nodes)], "pos int, id string, depth int")


def g8_induced(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return t.induced_edges(g, g.nodes.where("kind in ('class', 'method')").select("id")).select("id", "source", "target")


def g9_unresolved(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return t.unresolved_of(current_refs(spark, d), _of_kind(g, "class")).select("id", "source", "label")


def g10_path_lengths(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    pairs = _of_kind(g, "package").select(F.col("id").alias("source"), F.lit("external:corelog:emit").alias("target"))
    return t.shortest_paths(g, pairs, 6).select("source", "target", "length")


def g11_paths(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    pairs = _of_kind(g, "package").select(F.col("id").alias("source"), F.lit("external:corelog:emit").alias("target"))
    return t.shortest_paths(g, pairs, 6)


def g12_impact_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, ("kind",), ("directed",))
    return t.impact_seeds(g, _of_kind(g, "module"))


def g13_impact(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, ("kind",), ("directed",))
    return t.impact(g, _of_kind(g, "class"), 3)


def g14_callers(spark: SparkSession, d: str) -> DataFrame:
    return t.adjacency(current_graph(spark, d), "incoming", ("calls",)).where("id <> other").groupBy("id").agg(F.count_distinct("other").alias("n_callers"))


def g14_callees(spark: SparkSession, d: str) -> DataFrame:
    return t.adjacency(current_graph(spark, d), "outgoing", ("calls",)).where("id <> other").groupBy("id").agg(F.count_distinct("other").alias("n_callees"))


def g17_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of each containing node, as a set with its incidences."""
    e = current_graph(spark, d).edges.where("relation = 'contains'")
    return e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_incidences"), F.count_distinct("target").alias("n_members"))


def f1_filter(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    ids = g.nodes.where("kind in ('class', 'function') and repo in ('atlas-core', 'brine-core')").select("id")
    return t.induced_edges(g, ids).select("id")


def f2_relations(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).edges.where(F.col("relation").isin(*t.IMPACT_RELATIONS)).groupBy("relation").agg(F.count("*").alias("n_edges"))


def f3_contexts(spark: SparkSession, d: str) -> DataFrame:
    e = current_graph(spark, d).edges.select("id", F.explode(t.context_of()).alias("context"))
    return e.groupBy("context").agg(F.count("*").alias("n_edges"))


def f6_direction(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    parts = [t.adjacency(g, x).groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(x).alias("direction"), "n") for x in ("incoming", "outgoing", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def t13_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations a node may be asked by: those of its edges and of its unbound references."""
    g = current_graph(spark, d)
    seen = t.adjacency(g).select("id", "relation")
    unbound = current_refs(spark, d).where("resolved_target is null").select(F.col("source").alias("id"), F.lower(F.trim("relation")).alias("relation"))
    return seen.unionByName(unbound).distinct().join(g.ids, "id", "left_semi")


def w1_refresh(spark: SparkSession, d: str) -> DataFrame:
    target = Generations(spark, scratch(spark, "nodes"))
    refresh(stream_table(spark, d, "nodes"), target, "id", ["generation", "indexed_at", "deleted", "kind", "file"])
    return target.read().select("id", "generation", "kind", "file")


QUERIES = {f.__name__: f for f in (d1_changes, d2_bind, d2_ambiguous, d2_reference_edges, d2_rebind, d4_delta, d5_digest, d6_bumped, d9_losses, d10_foreign, f1_filter, f2_relations, f3_contexts, f6_direction, g1_adjacency, g1_incoming, g2_walk, g3_neighbors, g4_explore, g5_explore_dfs, g8_induced, g9_unresolved, g10_path_lengths, g11_paths, g12_impact_seeds, g13_impact, g14_callers, g14_callees, g17_members, t13_relations, w1_refresh)}

WITH = f"WITH {SQL}"
REC = f"WITH RECURSIVE {SQL}"
_KEYS = ", k AS (SELECT DISTINCT key, node_id FROM (SELECT binding_key AS key, id AS node_id FROM gn WHERE binding_key IS NOT NULL UNION ALL SELECT binding_key, node_id FROM node_aliases WHERE node_id IN (SELECT id FROM gn) AND binding_key IS NOT NULL)), c AS (SELECT key, count(*) AS n, min(node_id) AS node_id FROM k GROUP BY 1)"
_BIND = _KEYS + ", asked AS (SELECT id, unnest(candidate_keys) AS key, generate_subscripts(candidate_keys, 1) AS p FROM gr), hit AS (SELECT * FROM (SELECT a.id, a.key, c.n, c.node_id, row_number() OVER (PARTITION BY a.id ORDER BY a.p) AS rn FROM asked a JOIN c USING (key)) WHERE rn = 1), bound AS (SELECT g.id AS ref_id, CASE WHEN h.n = 1 THEN h.node_id END AS target, h.key, CASE WHEN h.id IS NULL THEN coalesce(nullif(g.reason, ''), 'no matching binding') WHEN h.n = 1 THEN '' ELSE 'ambiguous binding: ' || h.key END AS reason FROM gr g LEFT JOIN hit h ON h.id = g.id)"
_OLD = f", oldn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM nodes WHERE generation <= {BASELINE}) WHERE rn = 1 AND NOT coalesce(deleted, false)), oldf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation DESC) AS rn FROM files WHERE generation <= {BASELINE}) WHERE rn = 1), newf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation DESC) AS rn FROM files) WHERE rn = 1), chg AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM oldf o FULL JOIN newf n ON o.path = n.path)"
_ADJ = ", adj AS (SELECT source AS id, {a} AS stream, id AS edge_id, target AS other, relation FROM ge WHERE {x} UNION ALL SELECT target, {b}, id, source, relation FROM ge WHERE {y})"
_BOTH, _OUT, _IN = _ADJ.format(a=0, b=1, x="true", y="true"), _ADJ.format(a=0, b=1, x="true", y="NOT directed"), _ADJ.format(a=1, b=0, x="NOT directed", y="true")
_IMPACT = ", ".join(f"'{x}'" for x in t.IMPACT_RELATIONS)
_ALIAS = "CASE " + " ".join(f"WHEN relation IN ({', '.join(repr(w) for w in ws)}) THEN '{n}'" for n, ws in __import__("meshline.functions.text", fromlist=["x"]).CONTEXT_ALIASES.items()) + " ELSE relation END"
_SEEDS = ", mem AS MATERIALIZED (SELECT DISTINCT source AS id, target AS child FROM ge WHERE relation IN ('contains', 'method', 'defines')), sd AS (SELECT id AS seed, id FROM gn WHERE kind = '{kind}' UNION SELECT s.seed, m.child FROM sd s JOIN mem m ON m.id = s.id)"
# shortest paths from one target backwards, level by level, the first parent by path, stream and edge
_PATHS = ", adj AS MATERIALIZED (SELECT target AS id, 0 AS stream, id AS edge_id, source AS other FROM ge UNION ALL SELECT source, 1, id, target FROM ge WHERE NOT directed), l0 AS (SELECT 'external:corelog:emit' AS id, 0 AS length, ['external:corelog:emit'] AS path, CAST([] AS VARCHAR[]) AS edges), r0 AS (SELECT * FROM l0)" + "".join(
    f", l{n} AS MATERIALIZED (SELECT other AS id, {n} AS length, list_append(path, other) AS path, list_append(edges, edge_id) AS edges FROM (SELECT a.other, a.edge_id, l.path, l.edges, row_number() OVER (PARTITION BY a.other ORDER BY l.path, a.stream, a.edge_id) AS rn FROM l{n - 1} l JOIN adj a ON a.id = l.id WHERE a.other NOT IN (SELECT id FROM r{n - 1})) WHERE rn = 1), r{n} AS (SELECT * FROM r{n - 1} UNION ALL SELECT * FROM l{n})"
    for n in range(1, 7)
)
ORACLES = {
    "d1_changes": WITH + _OLD + " SELECT * FROM chg",
    "d2_bind": WITH + _BIND + " SELECT * FROM bound",
    "d2_ambiguous": WITH + _BIND + " SELECT key, count(*) AS n_refs FROM bound WHERE reason LIKE 'ambiguous binding: %' GROUP BY 1",
    "d2_reference_edges": WITH + _BIND + " SELECT 'reference:' || g.id AS id, g.source, b.target, lower(trim(g.relation)) AS relation FROM bound b JOIN gr g ON g.id = b.ref_id WHERE b.target IS NOT NULL",
    "d2_rebind": WITH + _BIND + " SELECT * FROM bound",
    "d4_delta": WITH + _OLD + f", oe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges WHERE generation <= {BASELINE}) WHERE rn = 1), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM nodes) WHERE rn = 1 AND NOT coalesce(deleted, false)), ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges) WHERE rn = 1), f AS (SELECT path FROM chg WHERE change <> 'unchanged'), rn1 AS (SELECT id FROM oldn WHERE file IS NULL OR file NOT IN (SELECT path FROM f) UNION ALL SELECT id FROM nn WHERE file IN (SELECT path FROM f)), re AS (SELECT id, source, target FROM oe WHERE file IS NULL OR file NOT IN (SELECT path FROM f) UNION ALL SELECT id, source, target FROM ne WHERE file IN (SELECT path FROM f)) SELECT 'node' AS record, id FROM rn1 UNION ALL SELECT 'edge', id FROM re WHERE source IN (SELECT id FROM rn1) AND target IN (SELECT id FROM rn1)",
    "d5_digest": WITH + " SELECT file, sha256(string_agg(id, ',' ORDER BY id)) AS digest FROM gn WHERE file IS NOT NULL GROUP BY 1",
    "d6_bumped": WITH + _OLD + ", a AS (SELECT file, string_agg(id, ',' ORDER BY id) AS h FROM oldn WHERE file IS NOT NULL GROUP BY 1), b AS (SELECT file, string_agg(id, ',' ORDER BY id) AS h FROM gn WHERE file IS NOT NULL GROUP BY 1) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.file = b.file WHERE a.h IS DISTINCT FROM b.h",
    "d9_losses": f"WITH o AS (SELECT file, count(*) AS n_old FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges WHERE generation <= {BASELINE}) WHERE rn = 1 AND upper(confidence) = 'INFERRED' GROUP BY 1), n AS (SELECT file, count(*) AS n_new FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges) WHERE rn = 1 AND upper(confidence) = 'INFERRED' GROUP BY 1) SELECT o.file, n_old, coalesce(n_new, 0) AS n_new FROM o LEFT JOIN n ON o.file = n.file WHERE coalesce(n_new, 0) < n_old",
    "d10_foreign": WITH + " SELECT e.id, e.file, s.file AS owner FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target WHERE e.file <> s.file",
    "f1_filter": WITH + ", x AS (SELECT id FROM gn WHERE kind IN ('class', 'function') AND repo IN ('atlas-core', 'brine-core')) SELECT id FROM ge WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x)",
    "f2_relations": WITH + f" SELECT relation, count(*) AS n_edges FROM ge WHERE relation IN ({_IMPACT}) GROUP BY 1",
    "f3_contexts": WITH + f" SELECT context, count(*) AS n_edges FROM (SELECT {_ALIAS} AS context FROM (SELECT coalesce(json_extract_string(metadata, '$.context'), relation) AS relation FROM ge)) GROUP BY 1",
    "f6_direction": WITH + " SELECT id, 'incoming' AS direction, count(*) AS n FROM (SELECT target AS id FROM ge UNION ALL SELECT source FROM ge WHERE NOT directed) GROUP BY 1 UNION ALL SELECT id, 'outgoing', count(*) FROM (SELECT source AS id FROM ge UNION ALL SELECT target FROM ge WHERE NOT directed) GROUP BY 1 UNION ALL SELECT id, 'both', count(*) FROM (SELECT source AS id FROM ge UNION ALL SELECT target FROM ge) GROUP BY 1",
    "g1_adjacency": WITH + _BOTH + " SELECT id, stream, edge_id, other FROM adj",
    "g1_incoming": WITH + _IN + " SELECT id, stream, edge_id, other FROM adj WHERE relation IN ('calls', 'uses')",
    "g2_walk": REC + _OUT + ", w AS (SELECT id AS seed, id, 0 AS depth FROM gn WHERE kind = 'package' UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN adj a ON a.id = w.id WHERE w.depth < 3) SELECT seed, id, min(depth) AS depth FROM w GROUP BY 1, 2",
    "g3_neighbors": REC + _BOTH + ", w AS (SELECT id AS seed, id, 0 AS depth FROM gn WHERE kind = 'package' UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN adj a ON a.id = w.id WHERE w.depth < 1) SELECT seed, id, min(depth) AS depth FROM w GROUP BY 1, 2",
    "g8_induced": WITH + ", x AS (SELECT id FROM gn WHERE kind IN ('class', 'method')) SELECT id, source, target FROM ge WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x)",
    "g9_unresolved": WITH + " SELECT id, source, label FROM gr WHERE resolved_target IS NULL AND source IN (SELECT id FROM gn WHERE kind = 'class')",
    "g4_explore": WITH + _INC + _BOTH + f", l0 AS (SELECT d.id FROM deg d JOIN gn n USING (id) WHERE NOT {NOISE.format(p='n.')} ORDER BY degree DESC, id LIMIT 1), l1 AS (SELECT other AS id, row_number() OVER (ORDER BY k) AS pos FROM (SELECT a.other, min((a.stream, a.edge_id)) AS k FROM adj a JOIN l0 USING (id) WHERE a.other NOT IN (SELECT id FROM l0) GROUP BY 1)), l2 AS (SELECT other AS id, row_number() OVER (ORDER BY k) AS pos FROM (SELECT a.other, min((l.pos, a.stream, a.edge_id)) AS k FROM adj a JOIN l1 l USING (id) WHERE a.other NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1) GROUP BY 1)) SELECT CAST(row_number() OVER (ORDER BY depth, pos) - 1 AS INTEGER) AS pos, id, depth FROM (SELECT id, 0 AS pos, 0 AS depth FROM l0 UNION ALL SELECT id, pos, 1 FROM l1 UNION ALL SELECT id, pos, 2 FROM l2) ORDER BY depth, pos LIMIT 200",
    "g11_paths": WITH + _PATHS + " SELECT p.id AS source, 'external:corelog:emit' AS target, CAST(r.length AS INTEGER) AS length, list_reverse(r.path) AS path, list_reverse(r.edges) AS edges FROM gn p LEFT JOIN r6 r ON r.id = p.id WHERE p.kind = 'package'",
    "g10_path_lengths": REC + _OUT + ", w AS (SELECT id AS seed, id, 0 AS depth FROM gn WHERE kind = 'package' UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN (SELECT DISTINCT id, other FROM adj) a ON a.id = w.id WHERE w.depth < 6) SELECT p.id AS source, 'external:corelog:emit' AS target, (SELECT min(depth) FROM w WHERE w.seed = p.id AND w.id = 'external:corelog:emit') AS length FROM gn p WHERE p.kind = 'package'",
    "g12_impact_seeds": REC + _SEEDS.format(kind="module") + " SELECT seed, id FROM sd",
    "g13_impact": REC + _IN + _SEEDS.format(kind="class") + f", ra AS MATERIALIZED (SELECT DISTINCT id, other FROM adj WHERE relation IN ({_IMPACT})), w AS (SELECT seed, id, 0 AS depth FROM sd UNION SELECT w.seed, a.other, w.depth + 1 FROM w JOIN ra a ON a.id = w.id WHERE w.depth < 3) SELECT seed, id, min(depth) AS depth FROM w GROUP BY 1, 2",
    "g14_callers": WITH + _IN + " SELECT id, count(DISTINCT other) AS n_callers FROM adj WHERE relation = 'calls' AND id <> other GROUP BY 1",
    "g14_callees": WITH + _OUT + " SELECT id, count(DISTINCT other) AS n_callees FROM adj WHERE relation = 'calls' AND id <> other GROUP BY 1",
    "g17_members": WITH + " SELECT source AS id, count(*) AS n_incidences, count(DISTINCT target) AS n_members FROM ge WHERE relation = 'contains' GROUP BY 1",
    "t13_relations": WITH + _BOTH + " SELECT DISTINCT id, relation FROM (SELECT id, relation FROM adj UNION ALL SELECT source, lower(trim(relation)) FROM gr WHERE resolved_target IS NULL) WHERE id IN (SELECT id FROM gn)",
    "w1_refresh": "SELECT id, generation, kind, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM nodes) WHERE rn = 1",
}
