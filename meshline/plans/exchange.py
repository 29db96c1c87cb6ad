"""Queries of composition, feedback, review data, extraction and export with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import compose as c
from meshline.operators import feedback as fb
from meshline.operators import resolve as r
from meshline.operators.graph import SQL, Graph, current_graph
from meshline.plans.navigation import _BIND, current_refs
from meshline.session import table
from meshline.sources import export as ex
from meshline.sources import extract as xt
from meshline.sources import node_link as nl
from meshline.tables import current_rows

NOW = 1_752_000_000


def _two(spark: SparkSession, d: str) -> Graph:
    g = current_graph(spark, d)
    a = Graph(g.nodes.where("repo < 'e'"), g.edges.join(g.nodes.where("repo < 'e'").select(F.col("id").alias("source")), "source", "left_semi").join(g.nodes.where("repo < 'e'").select(F.col("id").alias("target")), "target", "left_semi"))
    b = Graph(g.nodes.where("repo >= 'e' or repo is null"), g.edges.join(g.nodes.where("repo >= 'e' or repo is null").select(F.col("id").alias("source")), "source", "left_semi").join(g.nodes.where("repo >= 'e' or repo is null").select(F.col("id").alias("target")), "target", "left_semi"))
    return c.merge({"first": a, "second": b})


def c1_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).nodes.select("id", "project", "label")


def c1_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).edges.select("id", "source", "target", "project")


def _named_packages(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with keys under which packages of different repositories share the first word of their folder."""
    named = F.concat(F.lit("package:folder:"), F.regexp_replace("label", "_[0-9a-z]+$", ""))
    return current_graph(spark, d).nodes.withColumn("binding_key", named).withColumn("project", F.coalesce("repo", F.lit("")))


def c2_link_packages(spark: SparkSession, d: str) -> DataFrame:
    return c.link_packages(_named_packages(spark, d))


def c2_package_classes(spark: SparkSession, d: str) -> DataFrame:
    return c.package_classes(_named_packages(spark, d))


def c3_link_references(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return c.link_references(current_refs(spark, d), r.node_keys(g.nodes, table(spark, d, "node_aliases")), g.nodes.select("id", "repo"))


def c5_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return c.fingerprint(current_graph(spark, d).edges, ["id", "source", "target", "relation"])


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Feedback events out of the documents of source memory: the node is a file the text belongs to."""
    docs = table(spark, d, "documents").where("source in ('memory', 'issue') and path is not null")
    outcome = F.when(F.col("doc_id") % 3 == 0, "useful").when(F.col("doc_id") % 3 == 1, "dead_end")
    return docs.select(F.col("doc_id").alias("event_id"), F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("at"), outcome.alias("outcome"), F.array("path").alias("nodes"))


def m3_decay(spark: SparkSession, d: str) -> DataFrame:
    return fb.decayed_scores(_events(spark, d), NOW).select("node_id", F.round("score", 6).alias("score"), "useful", "negative", "future")


def m5_lessons(spark: SparkSession, d: str) -> DataFrame:
    s = fb.decayed_scores(_events(spark, d), NOW, 0.0)
    return s.orderBy(F.desc("score"), "node_id").limit(25).select("node_id", F.round("score", 6).alias("score"))


def m6_unique_labels(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return fb.unique_labels(table(spark, d, "refs").select(F.col("label").alias("citation")).distinct(), g.nodes)


def p_file_impact(spark: SparkSession, d: str) -> DataFrame:
    """Paths of documents without their repository, matched against the files of the graph."""
    paths = table(spark, d, "documents").where("path is not null").select(F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    return fb.file_matches(paths, current_graph(spark, d).nodes.where("file is not null").select("file"))


def p_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests (documents of that source) that touch the same file."""
    prs = table(spark, d, "documents").where("source = 'pull_request' and path is not null").select(F.col("doc_id").alias("change_id"), "path")
    return fb.overlaps(prs)


def s8_external_stubs(spark: SparkSession, d: str) -> DataFrame:
    declared = current_graph(spark, d).nodes.where("repo is not null")
    edges = current_rows(table(spark, d, "edges"), "id", ["generation", "source", "target", "relation"])
    return nl.external_stubs(declared, edges)


def s2_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    cur = current_rows(table(spark, d, "files"), "path", ["generation", "content", "n_bytes"])
    return cur.select("path", F.sha2("content", 256).alias("digest"), F.when(F.octet_length("content") > 4 << 20, True).otherwise(False).alias("oversize"))


def s3_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).nodes.select("id", "label", "kind", "file", "line")


def x1_language(spark: SparkSession, d: str) -> DataFrame:
    cur = current_rows(table(spark, d, "files"), "path", ["generation"])
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    return cur.groupBy(ext.alias("extension")).agg(F.count("*").alias("n_files"))


def x2_document_facts(spark: SparkSession, d: str) -> DataFrame:
    return xt.document_facts(table(spark, d, "documents")).groupBy("fact").agg(F.count("*").alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"))


def x2_headings(spark: SparkSession, d: str) -> DataFrame:
    return xt.document_facts(table(spark, d, "documents")).where("fact = 'heading'").select("doc_id", "name", "level", "line")


def x6_urls(spark: SparkSession, d: str) -> DataFrame:
    """Literal URLs of all texts, straight from the plan."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://[^\\s<>()\"'`\\]]+"), F.lit(0))).alias("url")).select("doc_id", F.regexp_replace("url", "[.,;:]+$", "").alias("url"))


def x8_suffix_aliases(spark: SparkSession, d: str) -> DataFrame:
    return xt.suffix_aliases(current_rows(table(spark, d, "files"), "path", ["generation"]).select("path")).groupBy("alias").agg(F.count("*").alias("n_paths"))


def x11_python_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all current files, Python and other kinds, chosen by extension or interpreter line."""
    cur = current_rows(table(spark, d, "files"), "path", ["generation", "content"])
    return xt.extract(cur.where("content is not null"))


def x21_document_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Keys by which prose links bind to code: the file's and, for named symbols, the file's with the name."""
    n = current_graph(spark, d).nodes.where("file is not null")
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array(F.concat(F.lit("file:"), F.col("file")), F.concat(F.lit("symbol:"), F.col("file"), F.lit("::"), F.col("label"))))))
    return n.select("id", F.explode(keys).alias("binding_key"))


def x23_entities(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    nodes, edges = xt.dedupe_entities(g.nodes, g.edges)
    return nodes.select(F.lit("node").alias("record"), "id").unionByName(edges.where("relation <> 'mentions'").select(F.lit("edge").alias("record"), "id"))


def k1_snapshot_json(spark: SparkSession, d: str) -> DataFrame:
    return ex.snapshot_rows(current_graph(spark, d))


def k2_node_link(spark: SparkSession, d: str) -> DataFrame:
    return ex.node_link_rows(current_graph(spark, d))


def k3_graphml(spark: SparkSession, d: str) -> DataFrame:
    return ex.graphml_rows(current_graph(spark, d))


def k4_cypher(spark: SparkSession, d: str) -> DataFrame:
    return ex.cypher_rows(current_graph(spark, d))


def k5_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return ex.mermaid_rows(current_graph(spark, d))


def k6_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return ex.edge_ordinals(current_graph(spark, d))


def k6_layout(spark: SparkSession, d: str) -> DataFrame:
    return ex.layout(current_graph(spark, d)).select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


def k9_canvas(spark: SparkSession, d: str) -> DataFrame:
    return ex.canvas(current_graph(spark, d).nodes.select("id", F.coalesce("repo", F.lit("")).alias("community")))


def k10_call_flow(spark: SparkSession, d: str) -> DataFrame:
    return ex.call_flow(current_graph(spark, d))


def k11_source_tree(spark: SparkSession, d: str) -> DataFrame:
    return ex.source_tree(current_graph(spark, d))


QUERIES = {f.__name__: f for f in (c1_merge_nodes, c1_merge_edges, c2_link_packages, c2_package_classes, c3_link_references, c5_fingerprint, m3_decay, m5_lessons, m6_unique_labels, s2_fingerprints, s3_snapshot, s8_external_stubs, x1_language, x2_document_facts, x2_headings, x6_urls, x8_suffix_aliases, x11_python_facts, x21_document_aliases, x23_entities, k1_snapshot_json, k2_node_link, k3_graphml, k4_cypher, k5_mermaid, k6_ordinals, k6_layout, k9_canvas, k10_call_flow, k11_source_tree)}
QUERIES |= {"review_file_impact": p_file_impact, "review_overlaps": p_overlaps}

WITH = f"WITH {SQL}"
_NS = "'project:' || to_json([{p}, {c}])"
_SIDES = ", nn AS (SELECT *, CASE WHEN repo < 'e' THEN 'first' ELSE 'second' END AS project FROM gn)"
_EV = ", ev AS (SELECT doc_id, epoch(created_at)::BIGINT AS ts, CASE doc_id % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'dead_end' END AS outcome, path AS node_id FROM documents WHERE source IN ('memory', 'issue') AND path IS NOT NULL)"
_PACKAGES = ", cl AS (SELECT 'package:folder:' || regexp_replace(label, '_[0-9a-z]+$', '') AS key, id, coalesce(repo, '') AS project FROM gn WHERE kind = 'package' AND NOT regexp_matches(label, '\\s') AND regexp_replace(label, '_[0-9a-z]+$', '') <> '')"
_DIGEST = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS UBIGINT)) AS VARCHAR)" for k in range(4))
_XML = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_ENT = "array_to_string(list_transform(string_split(coalesce({0}, ''), ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9]?') THEN c ELSE '#' || ord(c) || ';' END), '')"
ORACLES = {
    "c1_merge_nodes": WITH + _SIDES + f" SELECT {_NS.format(p='project', c='id')} AS id, project, label FROM nn",
    "c1_merge_edges": WITH + _SIDES + f" SELECT {_NS.format(p='s.project', c='e.id')} AS id, {_NS.format(p='s.project', c='e.source')} AS source, {_NS.format(p='s.project', c='e.target')} AS target, s.project FROM ge e JOIN nn s ON s.id = e.source JOIN nn t ON t.id = e.target WHERE s.project = t.project",
    "c2_link_packages": WITH + _PACKAGES + " SELECT x.key, x.id AS a, y.id AS b FROM cl x JOIN cl y ON x.key = y.key AND x.id < y.id AND x.project <> y.project",
    "c2_package_classes": WITH + _PACKAGES + " SELECT x.key, x.id, x.project, count(*) AS n_links FROM cl x JOIN cl y ON x.key = y.key AND x.project <> y.project GROUP BY 1, 2, 3",
    "c3_link_references": WITH + _BIND + " SELECT b.ref_id, b.target, b.key FROM bound b JOIN gr g ON g.id = b.ref_id JOIN gn n ON n.id = b.target WHERE g.resolved_target IS NULL AND n.repo IS NOT NULL AND g.repo IS DISTINCT FROM n.repo",
    "k1_snapshot_json": WITH + " SELECT 'node' AS record, id, to_json({binding_key: binding_key, end_line: end_line, file: file, id: id, kind: kind, label: label, line: line, metadata: metadata, qualified_name: qualified_name, repo: repo}) AS json FROM gn UNION ALL SELECT 'edge', id, to_json({confidence: confidence, directed: directed, file: file, id: id, line: line, metadata: metadata, ref_id: ref_id, relation: relation, source: source, target: target}) FROM ge",
    "k2_node_link": WITH + " SELECT 'node' AS record, to_json({id: id, label: label, file_type: kind, source_file: file, original: {binding_key: binding_key, end_line: end_line, file: file, id: id, kind: kind, label: label, line: line, metadata: metadata, qualified_name: qualified_name, repo: repo}}) AS json FROM gn UNION ALL SELECT 'link', to_json({source: source, target: target, key: id, relation: relation, confidence: confidence, directed: directed, _src: source, _tgt: target, original: {confidence: confidence, directed: directed, file: file, id: id, line: line, metadata: metadata, ref_id: ref_id, relation: relation, source: source, target: target}}) FROM ge",
    "c5_fingerprint": WITH + f", h AS (SELECT sha256(concat_ws(chr(31), {', '.join(f'coalesce({c}, chr(1))' for c in ('id', 'source', 'target', 'relation'))})) AS h FROM ge) SELECT count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_DIGEST})) AS fingerprint FROM h",
    "k3_graphml": WITH + f" SELECT 'node' AS record, '<node id=\"' || {_XML.format('id')} || '\"><data key=\"label\">' || {_XML.format('label')} || '</data></node>' AS xml FROM gn UNION ALL SELECT 'edge', '<edge id=\"' || {_XML.format('id')} || '\" source=\"' || {_XML.format('source')} || '\" target=\"' || {_XML.format('target')} || '\" directed=\"' || CAST(directed AS VARCHAR) || '\"><data key=\"relation\">' || {_XML.format('relation')} || '</data></edge>' FROM ge",
    "k5_mermaid": WITH + f" SELECT '  n' || substr(sha256(id), 1, 16) || '[\"' || {_ENT.format('label')} || '\"]' AS line FROM gn UNION ALL SELECT '  n' || substr(sha256(source), 1, 16) || CASE WHEN directed THEN ' -->|' ELSE ' ---|' END || {_ENT.format('relation')} || '| n' || substr(sha256(target), 1, 16) FROM ge",
    "m3_decay": WITH + _EV + f" SELECT node_id, round(round(coalesce(sum(CASE WHEN outcome = 'useful' THEN w WHEN outcome IS NOT NULL THEN -w END) FILTER (WHERE ts <= {NOW}), 0), 9), 6) AS score, count(*) FILTER (WHERE outcome = 'useful' AND ts <= {NOW}) AS useful, count(*) FILTER (WHERE outcome <> 'useful' AND ts <= {NOW}) AS negative, count(*) FILTER (WHERE ts > {NOW}) AS future FROM (SELECT *, pow(2.0, -(({NOW} - ts) / 86400.0) / 30.0) AS w FROM ev) GROUP BY 1",
    "m5_lessons": WITH + _EV + f" SELECT node_id, CAST(coalesce(sum(CASE WHEN outcome = 'useful' THEN 1 WHEN outcome IS NOT NULL THEN -1 END) FILTER (WHERE ts <= {NOW}), 0) AS DOUBLE) AS score FROM ev GROUP BY 1 ORDER BY score DESC, node_id LIMIT 25",
    "m6_unique_labels": WITH + ", cit AS (SELECT DISTINCT label AS citation FROM refs), i AS (SELECT c.citation, g.id AS node_id FROM cit c JOIN gn g ON g.id = c.citation) SELECT * FROM i UNION ALL SELECT c.citation, l.node_id FROM cit c JOIN (SELECT label, min(id) AS node_id FROM gn GROUP BY 1 HAVING count(*) = 1) l ON l.label = c.citation WHERE c.citation NOT IN (SELECT citation FROM i)",
    "review_file_impact": WITH + ", p AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS path FROM documents WHERE path IS NOT NULL), f AS (SELECT DISTINCT file FROM gn WHERE file IS NOT NULL), h AS (SELECT p.path, f.file FROM p JOIN f ON f.file = p.path OR f.file LIKE '%/' || replace(p.path, '_', '\\_') ESCAPE '\\'), a AS (SELECT path, bool_or(file = path) AS e, count(*) AS n, min(file) AS m FROM h GROUP BY 1) SELECT p.path, CASE WHEN e THEN p.path WHEN n = 1 THEN m END AS file, CASE WHEN e THEN 1 ELSE coalesce(n, 0) END AS n FROM p LEFT JOIN a USING (path)",
    "review_overlaps": "WITH c AS (SELECT DISTINCT doc_id, path FROM documents WHERE source = 'pull_request' AND path IS NOT NULL) SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared FROM c x JOIN c y ON x.path = y.path AND x.doc_id < y.doc_id GROUP BY 1, 2",
    "s2_fingerprints": "SELECT path, sha256(content) AS digest, coalesce(octet_length(encode(content)) > 4194304, false) AS oversize FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY generation DESC) AS rn FROM files) WHERE rn = 1",
    "s3_snapshot": WITH + " SELECT id, label, kind, file, line FROM gn",
    "s8_external_stubs": WITH + ", dn AS (SELECT id FROM gn WHERE repo IS NOT NULL), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges) WHERE rn = 1) SELECT DISTINCT target AS id FROM cur WHERE lower(trim(relation)) IN ('imports', 'imports_from', 're_exports') AND source IN (SELECT id FROM dn) AND target NOT IN (SELECT id FROM dn)",
    "x1_language": "SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, count(*) AS n_files FROM (SELECT DISTINCT path FROM files) GROUP BY 1",
    "x6_urls": r"""SELECT doc_id, regexp_replace(u, '[.,;:]+$', '') AS url FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>()"''`\]]+')) AS u FROM documents)""",
    "x8_suffix_aliases": r"WITH p AS (SELECT DISTINCT path, string_split(regexp_replace(path, '\.[^./]*$', ''), '/') AS s FROM files) SELECT alias, count(*) AS n_paths FROM (SELECT array_to_string(s[k:], '/') AS alias FROM p, generate_series(1, 64) g(k) WHERE k <= len(s)) GROUP BY 1",
    "x21_document_aliases": WITH + " SELECT DISTINCT id, k AS binding_key FROM (SELECT id, 'file:' || file AS k FROM gn WHERE file IS NOT NULL UNION ALL SELECT id, 'symbol:' || file || '::' || label FROM gn WHERE file IS NOT NULL AND label IS NOT NULL)",
    "x23_entities": WITH + ", k AS (SELECT id, min(id) OVER (PARTITION BY file, kind, trim(label)) AS keep FROM gn WHERE kind IN ('concept', 'entity')), e AS (SELECT g.id, g.relation, coalesce(a.keep, g.source) AS s, coalesce(b.keep, g.target) AS t FROM ge g LEFT JOIN k a ON a.id = g.source LEFT JOIN k b ON b.id = g.target) SELECT 'node' AS record, id FROM gn WHERE id NOT IN (SELECT id FROM k WHERE id <> keep) UNION ALL SELECT 'edge', id FROM e WHERE s <> t AND relation <> 'mentions'",
    "k4_cypher": WITH + ", q AS (SELECT 1) SELECT 'MERGE (n:Node {id: ' || chr(39) || id || chr(39) || '}) SET n.label = ' || chr(39) || coalesce(label, '') || chr(39) || ', n.kind = ' || chr(39) || coalesce(kind, '') || chr(39) || ';' AS statement FROM gn UNION ALL SELECT 'MATCH (a:Node {id: ' || chr(39) || source || chr(39) || '}), (b:Node {id: ' || chr(39) || target || chr(39) || '}) MERGE (a)-[r:EDGE {id: ' || chr(39) || id || chr(39) || '}]->(b) SET r.relation = ' || chr(39) || relation || chr(39) || ';' FROM ge",
    "k6_ordinals": WITH + " SELECT id, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY id) AS ordinal FROM ge",
    "k6_layout": WITH + ", k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM gn) SELECT id, round((greatest(22 * n, 640) / 2 - 100) * cos(2 * pi() * k / n), 3) + 0.0 AS x, round((greatest(22 * n, 640) / 2 - 100) * sin(2 * pi() * k / n), 3) + 0.0 AS y FROM k",
    "k9_canvas": WITH + ", k AS (SELECT id, coalesce(repo, '') AS community, row_number() OVER (PARTITION BY coalesce(repo, '') ORDER BY id) - 1 AS k FROM gn) SELECT id, community, CAST(k % 4 * 330 AS INTEGER) AS x, CAST(k // 4 * 240 AS INTEGER) AS y FROM k",
    "k10_call_flow": WITH + " SELECT n.file, e.relation, count(*) AS n_edges FROM ge e JOIN gn n ON n.id = e.source WHERE n.file IS NOT NULL AND e.relation IN ('calls', 'calls_method', 'uses', 'imports', 'imports_from', 're_exports') GROUP BY 1, 2",
    "k11_source_tree": WITH + ", o AS (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY coalesce(line, 0), label, id) AS a, row_number() OVER (PARTITION BY file ORDER BY coalesce(line, 0) DESC, label DESC, id DESC) AS b, count(*) OVER (PARTITION BY file) AS n FROM gn WHERE file IS NOT NULL) SELECT file, n AS n_nodes, max(id) FILTER (WHERE a = 1) AS first, max(id) FILTER (WHERE b = 1) AS last FROM o GROUP BY 1, 2",
}
