"""Queries of the whole-graph metrics with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import metrics as m
from meshline.operators.graph import SQL, current_graph
from meshline.session import table
from meshline.tables import current_rows

WITH = f"WITH {SQL}"
_INC = ", inc AS (SELECT source AS id, 1 AS o, CASE WHEN directed THEN 0 ELSE 1 END AS i, weight FROM ge UNION ALL SELECT target, CASE WHEN directed THEN 0 ELSE 1 END, 1, weight FROM ge), deg AS (SELECT n.id, count(i.id) AS degree, CAST(coalesce(sum(i.i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(i.o), 0) AS BIGINT) AS out_degree, coalesce(sum(i.weight), 0.0) AS weighted_degree FROM gn n LEFT JOIN inc i ON i.id = n.id GROUP BY 1)"
_ARC = ", arc AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT source AS src, target AS dst, weight FROM ge UNION ALL SELECT target, source, weight FROM ge WHERE NOT directed) GROUP BY 1, 2)"
_BASE = "regexp_extract(replace(coalesce({p}file, ''), '\\', '/'), '[^/]*$')"
NOISE = "(coalesce({p}kind, '') IN ('module', 'file', 'group') OR NOT contains(" + _BASE + ", '.') OR trim(coalesce({p}label, '')) IN (" + ", ".join(f"'{x}'" for x in m.BUILTIN_LABELS) + ") OR (lower(" + _BASE + ") LIKE '%.json' AND lower(trim(coalesce({p}label, ''))) IN (" + ", ".join(f"'{x}'" for x in m.JSON_LABELS) + ")))"
INSIGHT = "(coalesce({p}kind, '') <> 'rationale' AND coalesce(json_extract_string({p}metadata, '$.file_type'), '') <> 'rationale' AND NOT " + NOISE + ")"
CATEGORY = "CASE WHEN lower(regexp_extract({f}, '[^.]*$')) IN (" + ", ".join(f"'{x}'" for x in m.CODE_EXTENSIONS) + ") THEN 'code' WHEN lower(regexp_extract({f}, '[^.]*$')) = 'pdf' THEN 'paper' WHEN lower(regexp_extract({f}, '[^.]*$')) IN (" + ", ".join(f"'{x}'" for x in m.IMAGE_EXTENSIONS) + ") THEN 'image' ELSE 'document' END"


def a1_degree(spark: SparkSession, d: str) -> DataFrame:
    return m.degree(current_graph(spark, d))


def a2_weights(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).weighted.select("id", "weight")


def a3_arc_matrix(spark: SparkSession, d: str) -> DataFrame:
    return m.arcs(current_graph(spark, d))


def a4_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return m.symmetric(current_graph(spark, d))


def a5_pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return m.pagerank(current_graph(spark, d), iterations=10)[0].select("id", F.round("rank", 9).alias("rank"))


def a5_pagerank(spark: SparkSession, d: str) -> DataFrame:
    ranks, rounds, converged = m.pagerank(current_graph(spark, d), iterations=60, tolerance=1e-6)
    return ranks.select("id", "rank", F.lit(rounds).alias("rounds"), F.lit(converged).alias("converged"))


def a14_hubs(spark: SparkSession, d: str) -> DataFrame:
    return m.hubs(current_graph(spark, d))


def a15_isolates(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return g.ids.join(ends, "id", "left_anti")


def a16_confidence(spark: SparkSession, d: str) -> DataFrame:
    return m.confidence_counts(current_graph(spark, d)).withColumn("percent", F.round("percent", 6))


def a17_cross_community(spark: SparkSession, d: str) -> DataFrame:
    return m.with_ends(current_graph(spark, d), "repo").where("s_repo <> t_repo").select("id", F.col("s_repo").alias("source_community"), F.col("t_repo").alias("target_community"))


def a18_file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return m.file_dependencies(current_graph(spark, d))


def a19_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).edges.where("relation = 'calls'").select("id", "source", "target")


def a20_import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return m.import_cycles(current_graph(spark, d))


def a28_stats(spark: SparkSession, d: str) -> DataFrame:
    return m.stats(current_graph(spark, d), current_rows(table(spark, d, "refs"), "id", ["generation", "indexed_at", "resolved_target"]))


def a29_diagnose(spark: SparkSession, d: str) -> DataFrame:
    return m.pair_diagnosis(current_graph(spark, d))


def a30_topics(spark: SparkSession, d: str) -> DataFrame:
    return m.topics(current_graph(spark, d))


def f7_noise(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).nodes.where(m.noise()).select("id")


def f8_insight(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).nodes.where(m.insight()).select("id")


def f9_category(spark: SparkSession, d: str) -> DataFrame:
    return current_graph(spark, d).nodes.groupBy(m.category(F.col("file")).alias("category")).agg(F.count("*").alias("n_nodes"))


def v1_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").groupBy("id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def v1_dangling(spark: SparkSession, d: str) -> DataFrame:
    edges = current_rows(table(spark, d, "edges"), "id", ["generation", "source", "target"])
    ids = current_graph(spark, d).ids
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source").alias("node_id")), F.struct(F.lit("target").alias("end"), F.col("target").alias("node_id")))).alias("e")).select("id", "e.*")
    return ends.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select("id", "end", "node_id")


def v2_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = current_graph(spark, d).edges
    a = F.when(F.col("directed"), F.col("source")).otherwise(F.least("source", "target"))
    b = F.when(F.col("directed"), F.col("target")).otherwise(F.greatest("source", "target"))
    return e.groupBy(a.alias("a"), b.alias("b"), "directed").agg(F.count("*").alias("n_edges"), F.count_distinct("relation").alias("n_relations")).where("n_edges > 1")


QUERIES = {f.__name__: f for f in (a1_degree, a2_weights, a3_arc_matrix, a4_symmetric, a5_pagerank_10, a5_pagerank, a14_hubs, a15_isolates, a16_confidence, a17_cross_community, a18_file_dependencies, a19_call_edges, a20_import_cycles, a28_stats, a29_diagnose, a30_topics, f7_noise, f8_insight, f9_category, v1_duplicate_ids, v1_dangling, v2_duplicate_pairs)}


def _pagerank_sql(rounds: int) -> str:
    out = WITH + _ARC + ", tot AS (SELECT src, sum(weight) AS total FROM arc WHERE weight > 0 GROUP BY 1), sh AS MATERIALIZED (SELECT a.src, a.dst, a.weight / t.total AS share FROM arc a JOIN tot t USING (src) WHERE a.weight > 0), n AS (SELECT count(*) AS n FROM gn), r0 AS (SELECT id, 1.0 / n AS rank, id NOT IN (SELECT src FROM tot) AS dangling FROM gn, n)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f", d{k} AS MATERIALIZED (SELECT (0.15 + 0.85 * coalesce(sum(rank) FILTER (WHERE dangling), 0)) / (SELECT n FROM n) AS base FROM {p}), r{k} AS MATERIALIZED (SELECT p.id, (SELECT base FROM d{k}) + 0.85 * coalesce(i.inflow, 0) AS rank, p.dangling FROM {p} p LEFT JOIN (SELECT s.dst AS id, sum(s.share * q.rank) AS inflow FROM sh s JOIN {p} q ON q.id = s.src GROUP BY 1) i ON i.id = p.id)"
    return out + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


ORACLES = {
    "a1_degree": WITH + _INC + " SELECT * FROM deg",
    "a2_weights": WITH + " SELECT id, weight FROM ge",
    "a3_arc_matrix": WITH + _ARC + " SELECT * FROM arc",
    "a4_symmetric": WITH + " SELECT a, b, sum(weight) AS weight FROM (SELECT source AS a, target AS b, weight FROM ge UNION ALL SELECT target, source, weight FROM ge) GROUP BY 1, 2",
    "a5_pagerank_10": _pagerank_sql(10),
    "a14_hubs": WITH + _INC + f" SELECT row_number() OVER (ORDER BY degree DESC, id) AS rank, id, degree AS score FROM (SELECT d.id, d.degree FROM deg d JOIN gn n USING (id) WHERE NOT {NOISE.format(p='n.')} ORDER BY degree DESC, id LIMIT 10)",
    "a15_isolates": WITH + " SELECT id FROM gn WHERE id NOT IN (SELECT source FROM ge UNION SELECT target FROM ge)",
    "a16_confidence": WITH + " SELECT confidence, count(*) AS n_edges, round(count(*) * 100.0 / (SELECT count(*) FROM ge), 6) AS percent FROM ge GROUP BY 1",
    "a17_cross_community": WITH + " SELECT e.id, s.repo AS source_community, t.repo AS target_community FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target WHERE s.repo <> t.repo",
    "a18_file_dependencies": WITH + " SELECT CASE WHEN e.directed THEN s.file ELSE least(s.file, t.file) END AS src_file, CASE WHEN e.directed THEN t.file ELSE greatest(s.file, t.file) END AS dst_file, e.relation, e.directed, count(*) AS n_edges, min(e.id) AS first_edge FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target WHERE s.file <> t.file GROUP BY 1, 2, 3, 4",
    "a19_call_edges": WITH + " SELECT id, source, target FROM ge WHERE relation = 'calls'",
    "a20_import_cycles": "WITH RECURSIVE " + SQL + ", l0 AS (SELECT s.file AS src, t.file AS dst, e.directed FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target WHERE e.relation IN ('imports', 'imports_from', 're_exports') AND s.file IS NOT NULL AND t.file IS NOT NULL), l AS MATERIALIZED (SELECT src, dst FROM l0 UNION SELECT dst, src FROM l0 WHERE NOT directed), reach AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM reach r JOIN l ON l.src = r.dst), scc AS (SELECT a.src AS file, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT component, file, count(*) OVER (PARTITION BY component) AS n_files FROM scc",
    "a28_stats": WITH + " SELECT 'nodes' AS metric, count(*) AS value FROM gn UNION ALL SELECT 'files', count(DISTINCT nullif(file, '')) FROM gn UNION ALL SELECT 'kinds', count(DISTINCT kind) FROM gn UNION ALL SELECT 'edges', count(*) FROM ge UNION ALL SELECT 'relations', count(DISTINCT relation) FROM ge UNION ALL SELECT 'references', count(*) FROM gr UNION ALL SELECT 'unresolved', count(*) FILTER (WHERE resolved_target IS NULL) FROM gr",
    "a29_diagnose": WITH + """, e AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b FROM ge), p AS (SELECT a, b, count(*) AS n, count(DISTINCT relation) AS r, count(DISTINCT directed) AS dd FROM e GROUP BY 1, 2),
 o AS (SELECT count(*) AS n FROM e GROUP BY source, target), k AS (SELECT count(*) AS n FROM e GROUP BY directed, CASE WHEN directed THEN source ELSE a END, CASE WHEN directed THEN target ELSE b END), s AS (SELECT count(*) AS n FROM e GROUP BY source, target, relation, directed, coalesce(file, ''), coalesce(line, -1), confidence)
 SELECT 'edges' AS metric, count(*) AS value FROM e UNION ALL SELECT 'directed', count(*) FILTER (WHERE directed) FROM e UNION ALL SELECT 'undirected', count(*) FILTER (WHERE NOT directed) FROM e UNION ALL SELECT 'self_loops', count(*) FILTER (WHERE source = target) FROM e
 UNION ALL SELECT 'ordered_collapse_loss', CAST(sum(n - 1) AS BIGINT) FROM o UNION ALL SELECT 'unordered_collapse_loss', CAST(sum(n - 1) AS BIGINT) FROM p UNION ALL SELECT 'mixed_direction_pairs', count(*) FILTER (WHERE dd > 1) FROM p UNION ALL SELECT 'relation_variant_pairs', count(*) FILTER (WHERE r > 1) FROM p
 UNION ALL SELECT 'parallel_groups', count(*) FROM k WHERE n > 1 UNION ALL SELECT 'parallel_extras', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM k UNION ALL SELECT 'duplicate_records', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM s""",
    "a30_topics": WITH + _INC + r", t AS (SELECT d.id, d.degree, trim(regexp_replace(n.label, '[^\p{L}\p{N}_ .-]+', ' ', 'g')) AS label FROM deg d JOIN gn n USING (id) WHERE n.kind NOT IN ('module', 'file', 'group', 'package', 'section') ORDER BY d.degree DESC, d.id LIMIT 64), f AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY degree DESC, id) AS n FROM t WHERE label <> '') SELECT rank, label FROM (SELECT row_number() OVER (ORDER BY degree DESC, id) AS rank, label FROM f WHERE n = 1) WHERE rank <= 8",
    "f7_noise": WITH + f" SELECT id FROM gn WHERE {NOISE.format(p='')}",
    "f8_insight": WITH + f" SELECT id FROM gn WHERE {INSIGHT.format(p='')}",
    "f9_category": WITH + f" SELECT {CATEGORY.format(f='file')} AS category, count(*) AS n_nodes FROM gn GROUP BY 1",
    "v1_duplicate_ids": "SELECT id, count(*) AS n_rows FROM edges GROUP BY 1 HAVING count(*) > 1",
    "v1_dangling": WITH + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM edges) WHERE rn = 1), ends AS (SELECT id, 'source' AS \"end\", source AS node_id FROM cur UNION ALL SELECT id, 'target', target FROM cur) SELECT * FROM ends WHERE node_id NOT IN (SELECT id FROM gn)",
    "v2_duplicate_pairs": WITH + " SELECT CASE WHEN directed THEN source ELSE least(source, target) END AS a, CASE WHEN directed THEN target ELSE greatest(source, target) END AS b, directed, count(*) AS n_edges, count(DISTINCT relation) AS n_relations FROM ge GROUP BY 1, 2, 3 HAVING count(*) > 1",
}
