"""Queries of search, communities and insights with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators import community as c
from meshline.operators import insights as ins
from meshline.operators import metrics as m
from meshline.operators import search as s
from meshline.operators.graph import SQL, current_graph
from meshline.plans.metrics import _INC, CATEGORY, INSIGHT, NOISE

TEXTS = ["packet schema", "which functions call the sorted route?", "budget", "load digest edge", "corelog"]
ENDPOINTS = ["corelog", "FoldCursor.traceVoucher", "render", "seg", "no such name"]


def _part(g) -> DataFrame:
    """The repository as a given partition; stubs form one of their own."""
    return g.nodes.select("id", F.coalesce("repo", F.lit("")).alias("community"))


def t2_postings(spark: SparkSession, d: str) -> DataFrame:
    return s.postings(current_graph(spark, d).nodes).groupBy("token").agg(F.count("*").alias("n_nodes"))


def t5_scores(spark: SparkSession, d: str) -> DataFrame:
    return s.ranked(current_graph(spark, d).nodes, TEXTS).withColumn("score", F.round("score", 6))


def t5_seeds(spark: SparkSession, d: str) -> DataFrame:
    return s.seeds(current_graph(spark, d).nodes, TEXTS)


def t7_exact(spark: SparkSession, d: str) -> DataFrame:
    return s.exact_lookup(current_graph(spark, d).nodes, ["external:corelog", "emit", "corelog", "module", "nothing at all"])


def t9_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return s.endpoint_tiers(current_graph(spark, d).nodes, ENDPOINTS)


def a6_louvain(spark: SparkSession, d: str) -> DataFrame:
    return c.partition(current_graph(spark, d, ("id",), ("metadata",)), "louvain")


def a7_leiden(spark: SparkSession, d: str) -> DataFrame:
    return c.partition(current_graph(spark, d, ("id",), ("metadata",)), "leiden")


def a8_connected_split(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, (), ("metadata",))
    return c.connected_split(m.loose_weights(g), _part(g))


def a9_modularity(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return c.modularity(m.symmetric(g), _part(g)).select(F.round("modularity", 9).alias("modularity"))


def a10_cohesion(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return c.cohesion(m.symmetric(g), _part(g)).withColumn("cohesion", F.round("cohesion", 9))


def a11_hub_cut(spark: SparkSession, d: str) -> DataFrame:
    deg = m.degree(current_graph(spark, d))
    return deg.where(F.col("degree") > F.lit(c.hub_threshold(deg, 99.0))).select("id", "degree")


def a13_canonical(spark: SparkSession, d: str) -> DataFrame:
    return c.canonical(_part(current_graph(spark, d)))


def a13_labels(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return c.labels(g, _part(g), m.degree(g))


def a31_signatures(spark: SparkSession, d: str) -> DataFrame:
    return c.signatures(_part(current_graph(spark, d)))


def _edges(g, deg: DataFrame) -> DataFrame:
    return ins.eligible_edges(g, _part(g), deg)


def a21_scores(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return ins.surprises(_edges(g, m.degree(g))).select("id", "score")


def a21_surprises(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return ins.top_surprises(ins.surprises(_edges(g, m.degree(g))))


def a22_bridges(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return ins.bridges(_edges(g, m.degree(g)))


def a23_inferred_hubs(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    deg = m.degree(g)
    return ins.inferred_hubs(g, _edges(g, deg), deg)


def a24_weak(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return ins.weak_nodes(g, m.degree(g))


def a25_low_cohesion(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return ins.low_cohesion(g, _part(g), c.cohesion(m.symmetric(g), _part(g))).withColumn("cohesion", F.round("cohesion", 9))


def a26_questions(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    deg = c.cut(m.degree(g))
    return ins.questions(g, c.cut(_edges(g, deg)), _part(g), deg, c.cohesion(m.symmetric(g), _part(g)))


QUERIES = {f.__name__: f for f in (t2_postings, t5_scores, t5_seeds, t7_exact, t9_endpoints, a6_louvain, a7_leiden, a8_connected_split, a9_modularity, a10_cohesion, a11_hub_cut, a13_canonical, a13_labels, a31_signatures, a21_scores, a21_surprises, a22_bridges, a23_inferred_hubs, a24_weak, a25_low_cohesion, a26_questions)}

WITH = f"WITH {SQL}"
_POST = r", txt AS (SELECT id, concat_ws(' ', id, coalesce(label, ''), coalesce(qualified_name, ''), coalesce(file, '')) AS x FROM gn), post AS MATERIALIZED (SELECT DISTINCT id, token FROM (SELECT id, unnest(regexp_split_to_array(lower(x || ' ' || regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')) AS token FROM txt) WHERE token <> '')"
_PART = ", part AS (SELECT id, coalesce(repo, '') AS community FROM gn), sym AS MATERIALIZED (SELECT a, b, sum(weight) AS weight FROM (SELECT source AS a, target AS b, weight FROM ge UNION ALL SELECT target, source, weight FROM ge) GROUP BY 1, 2)"
_COH = ", pr AS (SELECT p.community, count(*) AS pairs FROM sym s JOIN part p ON p.id = s.a JOIN part q ON q.id = s.b WHERE s.weight > 0 AND s.a <> s.b AND p.community = q.community GROUP BY 1), coh AS (SELECT community, size, coalesce(pairs, 0) AS pairs, CASE WHEN size < 2 THEN 0.0 ELSE coalesce(pairs, 0) / (size * (size - 1)) END AS cohesion FROM (SELECT community, count(*) AS size FROM part GROUP BY 1) z LEFT JOIN pr USING (community))"
_STRUCT = ", ".join(f"'{x}'" for x in ins.STRUCTURAL)
_ELIG = _INC + _PART + f", info AS (SELECT n.id, coalesce(replace(n.file, '\\', '/'), '') AS file, p.community, d.degree FROM gn n JOIN part p USING (id) JOIN deg d USING (id) WHERE {INSIGHT.format(p='n.')}), el AS (SELECT e.id, e.source, e.target, e.relation, e.confidence, s.file AS s_file, t.file AS t_file, s.community AS s_community, t.community AS t_community, s.degree AS s_degree, t.degree AS t_degree FROM ge e JOIN info s ON s.id = e.source JOIN info t ON t.id = e.target)"
_SUR = _ELIG + f", sur AS (SELECT id, source, target, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 WHEN 'EXTRACTED' THEN 1 ELSE 0 END + (s_file <> t_file)::INT + 2 * (regexp_extract(s_file, '^(.*)/[^/]*$', 1) <> regexp_extract(t_file, '^(.*)/[^/]*$', 1))::INT + 2 * ({CATEGORY.format(f='s_file')} <> {CATEGORY.format(f='t_file')})::INT + (s_community <> t_community)::INT + (least(s_degree, t_degree) <= 2 AND greatest(s_degree, t_degree) >= 5)::INT AS score FROM el WHERE relation NOT IN ({_STRUCT}) AND NOT (s_file = t_file AND s_community = t_community))"
_BRI = f", br AS (SELECT id, count(DISTINCT other) AS n_communities, count(*) AS n_edges FROM (SELECT source AS id, t_community AS other FROM el WHERE relation NOT IN ({_STRUCT}) AND s_community <> t_community UNION ALL SELECT target, s_community FROM el WHERE relation NOT IN ({_STRUCT}) AND s_community <> t_community) GROUP BY 1)"
_HUB = f", hub5 AS (SELECT d.id, d.degree FROM deg d JOIN gn n USING (id) WHERE {INSIGHT.format(p='n.')} ORDER BY d.degree DESC, d.id LIMIT 5), inf AS (SELECT id, count(*) AS n_inferred FROM (SELECT source AS id FROM el WHERE confidence = 'INFERRED' UNION ALL SELECT target FROM el WHERE confidence = 'INFERRED' AND source <> target) GROUP BY 1 HAVING count(*) >= 2)"
_WEAK = f", weak AS (SELECT d.id, d.degree FROM deg d JOIN gn n USING (id) WHERE d.degree <= 1 AND {INSIGHT.format(p='n.')})"
_LOW = ", low AS (SELECT community, cohesion, n_eligible FROM coh JOIN (SELECT community, count(*) AS n_eligible FROM info GROUP BY 1) USING (community) WHERE cohesion < 0.15 AND n_eligible >= 5)"


def _terms_sql() -> str:
    from meshline.functions import text as tx

    rows = [(q, len(ts), k, t) for q in TEXTS for ts in [tx.search_terms(q)] for k, t in enumerate(map(tx.normalize, ts))]
    return ", qt(query, n_terms, ord, term) AS (VALUES " + ", ".join(f"('{q}', {n}, {k}, '{t}')" for q, n, k, t in rows) + ")"


_WEIGHTS = r", hit AS (SELECT DISTINCT q.query, q.n_terms, q.ord, q.term, p.id FROM qt q JOIN post p ON starts_with(p.token, q.term)), w AS (SELECT h.query, h.n_terms, h.ord, h.id, lower(n.label) AS name, strlen(n.label) AS size, CASE WHEN l = h.term OR lower(n.id) = h.term THEN 12.0 WHEN list_contains(regexp_split_to_array(l, '[^a-z0-9]+'), h.term) THEN 8.0 WHEN starts_with(l, h.term) THEN 6.0 WHEN contains(l, h.term) THEN 3.0 WHEN contains(lower(coalesce(n.qualified_name, '')), h.term) THEN 2.0 ELSE 1.0 END AS w, contains(lower(n.label), h.term)::INT AS c FROM hit h JOIN (SELECT *, regexp_replace(lower(label), '(\(\))+$', '') AS l FROM gn) n USING (id))"
_SEEDS = ", known AS (SELECT query, id, name, size, CAST(sum(w) AS DOUBLE) * (1 + (sum(c) / n_terms) * (sum(c) / n_terms)) AS score FROM w GROUP BY query, id, n_terms, name, size), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, name ORDER BY score DESC, size, id) AS k FROM known) WHERE k = 1), top AS (SELECT * FROM (SELECT query, 0 AS stage, row_number() OVER (PARTITION BY query ORDER BY score DESC, size, id) AS ord, id, name, score, max(score) OVER (PARTITION BY query) AS most FROM best) WHERE ord <= 3 AND score >= 0.2 * most), per AS (SELECT query, 1 AS stage, ord, id, name, CAST(w AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, ord ORDER BY w DESC, id) AS k FROM w) WHERE k = 1), picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, name ORDER BY stage, ord) AS k FROM (SELECT query, stage, ord, id, name, score FROM top UNION ALL SELECT * FROM per)) WHERE k = 1), by_id AS (SELECT DISTINCT query, id FROM qt JOIN gn ON id = query), ex AS (SELECT * FROM by_id UNION SELECT query, id FROM qt JOIN gn ON label = query OR qualified_name = query OR file = query WHERE query NOT IN (SELECT query FROM by_id))"


_DIGEST = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS UBIGINT)) AS VARCHAR)" for k in range(4))
ORACLES = {
    "a31_signatures": WITH + _PART + f" SELECT community, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_DIGEST})) AS signature FROM (SELECT community, sha256(id) AS h FROM part) GROUP BY 1",
    "t2_postings": WITH + _POST + " SELECT token, count(*) AS n_nodes FROM post GROUP BY 1",
    "t5_scores": WITH + _POST + _terms_sql() + _WEIGHTS + " SELECT query, id, round(CAST(sum(w) AS DOUBLE) * (1 + (sum(c) / n_terms) * (sum(c) / n_terms)), 6) AS score FROM w GROUP BY query, id, n_terms",
    "t5_seeds": WITH + _POST + _terms_sql() + _WEIGHTS + _SEEDS + " SELECT query, row_number() OVER (PARTITION BY query ORDER BY stage, ord) - 1 AS pos, id, score FROM picked WHERE query NOT IN (SELECT query FROM ex) UNION ALL SELECT query, pos - 1, id, NULL FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS pos FROM ex) WHERE pos <= 21",
    "t7_exact": WITH + ", q(query) AS (VALUES ('external:corelog'), ('emit'), ('corelog'), ('module'), ('nothing at all')), a AS (SELECT query, 0 AS tier, id FROM q JOIN gn ON id = query), b AS (SELECT DISTINCT query, 1 AS tier, id FROM q JOIN gn ON label = query OR qualified_name = query OR file = query WHERE query NOT IN (SELECT query FROM a)) SELECT query, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn <= 21",
    "t9_endpoints": WITH + ", q(query) AS (VALUES " + ", ".join(f"('{x}')" for x in ENDPOINTS) + r"), n AS (SELECT id, lower(id) AS i, lower(label) AS l, lower(coalesce(qualified_name, '')) AS qn FROM gn), h AS (SELECT query, id, CASE WHEN regexp_replace(l, '\(\)$', '') = lower(query) OR i = lower(query) OR regexp_replace(qn, '\(\)$', '') = lower(query) THEN 0 WHEN qn LIKE '%.' || lower(query) OR qn LIKE '% ' || lower(query) THEN 1 WHEN starts_with(l, lower(query)) OR starts_with(qn, lower(query)) THEN 2 WHEN contains(l, lower(query)) OR contains(qn, lower(query)) THEN 3 END AS tier FROM q, n) SELECT query, tier, n, CASE WHEN n = 1 THEN id END AS id FROM (SELECT query, tier, count(*) AS n, min(id) AS id, row_number() OVER (PARTITION BY query ORDER BY tier) AS rn FROM h WHERE tier IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
    "a8_connected_split": f"WITH RECURSIVE {SQL}" + _PART + ", lk AS MATERIALIZED (SELECT s.a, s.b FROM sym s JOIN part p ON p.id = s.a JOIN part q ON q.id = s.b WHERE s.weight > 0 AND p.community = q.community), reach AS (SELECT id AS a, id AS b FROM part UNION SELECT r.a, l.b FROM reach r JOIN lk l ON l.a = r.b) SELECT a AS id, min(b) AS community FROM reach GROUP BY 1",
    "a9_modularity": WITH + _PART + " SELECT round(sum(i / t - (k / t) * (k / t)), 9) AS modularity FROM (SELECT p.community, sum(CASE WHEN p.community = q.community THEN s.weight ELSE 0 END) AS i, sum(s.weight) AS k FROM sym s JOIN part p ON p.id = s.a JOIN part q ON q.id = s.b GROUP BY 1), (SELECT sum(weight) AS t FROM sym)",
    "a10_cohesion": WITH + _PART + _COH + " SELECT community, size, pairs, round(cohesion, 9) AS cohesion FROM coh",
    "a11_hub_cut": WITH + _INC + ", o AS (SELECT degree, row_number() OVER (ORDER BY degree) AS rn, count(*) OVER () AS n FROM deg) SELECT id, degree FROM deg WHERE degree > (SELECT degree FROM o WHERE rn = greatest(0, CAST(floor(n * 99.0 / 100) AS BIGINT) - 1) + 1)",
    "a13_canonical": WITH + _PART + ", f AS (SELECT community, dense_rank() OVER (ORDER BY min(id)) - 1 AS n FROM part GROUP BY 1) SELECT id, n AS community FROM part JOIN f USING (community)",
    "a13_labels": WITH + _INC + _PART + f", r AS (SELECT p.community, n.id, n.label, row_number() OVER (PARTITION BY p.community ORDER BY d.degree DESC, n.id) AS rn FROM part p JOIN gn n USING (id) JOIN deg d USING (id) WHERE NOT {NOISE.format(p='n.')}) SELECT z.community, z.size, coalesce(r.label, 'Community ' || z.community) AS label, r.id AS label_id FROM (SELECT community, count(*) AS size FROM part GROUP BY 1) z LEFT JOIN r ON r.community = z.community AND r.rn = 1",
    "a21_scores": WITH + _SUR + " SELECT id, score FROM sur",
    "a21_surprises": WITH + _SUR + " SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM (SELECT * FROM sur ORDER BY score DESC, id LIMIT 5)",
    "a22_bridges": WITH + _ELIG + _BRI + " SELECT * FROM br",
    "a23_inferred_hubs": WITH + _ELIG + _HUB + " SELECT id, n_inferred FROM inf WHERE id IN (SELECT id FROM hub5)",
    "a24_weak": WITH + _INC + _WEAK + " SELECT * FROM weak",
    "a25_low_cohesion": WITH + _ELIG + _COH + _LOW + " SELECT community, round(cohesion, 9) AS cohesion, n_eligible FROM low",
    "a26_questions": WITH + _ELIG + _BRI + _HUB + _WEAK + _COH + _LOW + ", qs AS (SELECT 0 AS k, 'ambiguous_edge' AS kind, row_number() OVER (ORDER BY id) AS r, id AS subject FROM el WHERE confidence = 'AMBIGUOUS' UNION ALL SELECT 1, 'bridge_node', row_number() OVER (ORDER BY n_communities DESC, n_edges DESC, id), id FROM br UNION ALL SELECT 2, 'verify_inferred', row_number() OVER (ORDER BY h.degree DESC, h.id), h.id FROM inf JOIN hub5 h USING (id) UNION ALL SELECT 3, 'isolated_nodes', 1, min(id) FROM weak HAVING min(id) IS NOT NULL UNION ALL SELECT 4, 'low_cohesion', row_number() OVER (ORDER BY cohesion, community), community FROM low) SELECT pos, kind, subject FROM (SELECT row_number() OVER (ORDER BY r, k) AS pos, kind, subject FROM qs) WHERE pos <= 7",
}
