"""Queries of the facade: reports, budgets, hubs apart, repeated splits, preserved memberships, vault notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.engine import GraphEngine
from meshline.operators import community as c
from meshline.operators import metrics as m
from meshline.operators.graph import SQL, current_graph
from meshline.operators.traverse import Options
from meshline.plans.navigation import current_refs


def a11_exclude_hubs(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d)
    return c.exclude_hubs(g, c.cut(m.symmetric(g)), 99.5)


def a12_split_again(spark: SparkSession, d: str) -> DataFrame:
    g = current_graph(spark, d, (), ("metadata",))
    return c.split_again(g, g.nodes.select("id", F.coalesce("repo", F.lit("")).alias("community")), least_cohesion=0.05)


def a27_preserved(spark: SparkSession, d: str) -> DataFrame:
    """Memberships carried in metadata: the repository as a text, its length as an integer."""
    n = current_graph(spark, d).nodes.where("repo is not null")
    as_text = n.select(F.to_json(F.struct(F.lit("p").alias("project"), F.col("repo").alias("community"))).alias("metadata"))
    as_number = n.select(F.to_json(F.struct(F.lit("p").alias("project"), F.length("repo").alias("community"))).alias("metadata"))
    return c.preserved(as_text.unionByName(as_number))


def g7_token_budget(spark: SparkSession, d: str) -> DataFrame:
    e = GraphEngine(current_graph(spark, d), current_refs(spark, d))
    a = e.query("corelog", Options(depth=1, limit=100), token_budget=2_000)
    return spark.createDataFrame([("node", x) for x in a.nodes] + [("edge", x) for x in a.edges] + [("unresolved", x) for x in a.unresolved], "record string, json string")


def k8_report(spark: SparkSession, d: str) -> DataFrame:
    lines = GraphEngine(current_graph(spark, d, ("metadata",), ("metadata",))).report().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def k12_vault(spark: SparkSession, d: str) -> DataFrame:
    """One note a node: its title, and links to what it points to, as the body of a vault of notes."""
    g = current_graph(spark, d)
    link = F.concat(F.lit("- "), "relation", F.lit(" [["), "target", F.lit("]]"))
    body = g.edges.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set(link)).alias("links"))
    return g.nodes.join(body, "id", "left").select("id", F.concat_ws("\n", F.concat(F.lit("# "), "label"), F.concat_ws("\n", "links")).alias("note"))


QUERIES = {f.__name__: f for f in (a11_exclude_hubs, a12_split_again, a27_preserved, g7_token_budget, k8_report, k12_vault)}
ORACLES = {
    "a27_preserved": f"WITH {SQL} SELECT 'p' AS project, 'string' AS community_type, repo AS community, count(*) AS size FROM gn WHERE repo IS NOT NULL GROUP BY 3 UNION ALL SELECT 'p', 'integer', CAST(length(repo) AS VARCHAR), count(*) FROM gn WHERE repo IS NOT NULL GROUP BY 3",
    "k12_vault": f"WITH {SQL}, l AS (SELECT source AS id, string_agg(x, chr(10) ORDER BY x) AS links FROM (SELECT DISTINCT source, '- ' || relation || ' [[' || target || ']]' AS x FROM ge) GROUP BY 1) SELECT n.id, '# ' || n.label || chr(10) || coalesce(l.links, '') AS note FROM gn n LEFT JOIN l USING (id)",
}
