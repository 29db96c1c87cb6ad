"""Insights over any partition: surprising connections, bridges, weak nodes, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshline.operators import metrics as m
from meshline.operators.graph import Graph

# Relations that describe structure, and points of recorded confidence.
STRUCTURAL = ("imports", "imports_from", "re_exports", "contains", "method", "member_of", "defines", "declares")
POINTS = {"AMBIGUOUS": 3, "INFERRED": 2, "EXTRACTED": 1}
SURPRISES, QUESTIONS = 5, 7


def eligible_edges(g: Graph, part: DataFrame, degree: DataFrame) -> DataFrame:
    """Edges between insight nodes with file, community and degree of both ends (``s_``, ``t_``)."""
    info = g.nodes.where(m.insight()).select("id", F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/")).alias("file")).join(part, "id").join(degree.select("id", "degree"), "id")
    s = info.select(F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in ("file", "community", "degree")])
    t = info.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in ("file", "community", "degree")])
    return g.edges.select("id", "source", "target", "relation", "confidence").join(s, "source").join(t, "target")


def surprises(edges: DataFrame) -> DataFrame:
    """(id, score, ...): points for recorded confidence and for crossing sources, folders, categories and communities."""
    x = edges.where(~F.col("relation").isin(*STRUCTURAL) & ~((F.col("s_file") == F.col("t_file")) & (F.col("s_community") == F.col("t_community"))))
    conf = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in POINTS.items()], F.lit(0))
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    mark = lambda cond, n: F.when(cond, n).otherwise(0)
    low, high = F.least("s_degree", "t_degree"), F.greatest("s_degree", "t_degree")
    signals = {
        "confidence_points": conf, "cross_source": mark(F.col("s_file") != F.col("t_file"), 1), "cross_directory": mark(folder("s_file") != folder("t_file"), 2),
        "cross_category": mark(m.category(F.col("s_file")) != m.category(F.col("t_file")), 2), "cross_community": mark(F.col("s_community") != F.col("t_community"), 1), "peripheral_hub": mark((low <= 2) & (high >= 5), 1),
    }
    out = x.select("id", "source", "target", *[v.alias(k) for k, v in signals.items()])
    return out.withColumn("score", sum((F.col(k) for k in signals), F.lit(0)))


def top_surprises(scored: DataFrame, keep: int = SURPRISES) -> DataFrame:
    best = scored.orderBy(F.desc("score"), "id").limit(keep)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"), "id", "score")


def bridges(edges: DataFrame) -> DataFrame:
    """(id, n_communities, n_edges): nodes whose non-structural edges reach other communities."""
    x = edges.where(~F.col("relation").isin(*STRUCTURAL) & (F.col("s_community") != F.col("t_community")))
    ends = x.select("id", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("t_community").alias("other")), F.struct(F.col("target").alias("node"), F.col("s_community").alias("other")))).alias("e"))
    per = ends.groupBy(F.col("e.node").alias("id"), "e.other").agg(F.count("*").alias("n"))
    return per.groupBy("id").agg(F.count("*").alias("n_communities"), F.sum("n").alias("n_edges"))


def inferred_hubs(g: Graph, edges: DataFrame, degree: DataFrame, top: int = 5) -> DataFrame:
    """(id, n_inferred): which of the top eligible hubs have two inferred edges or more."""
    best = degree.join(g.nodes.where(m.insight()).select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(top).select("id")
    ends = edges.where("confidence = 'INFERRED'").select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n_inferred")).where("n_inferred >= 2").join(best, "id", "left_semi")


def weak_nodes(g: Graph, degree: DataFrame) -> DataFrame:
    return degree.where("degree <= 1").join(g.nodes.where(m.insight()).select("id"), "id", "left_semi").select("id", "degree")


def low_cohesion(g: Graph, part: DataFrame, cohesion: DataFrame, below: float = 0.15, least: int = 5) -> DataFrame:
    members = part.join(g.nodes.where(m.insight()).select("id"), "id", "left_semi").groupBy("community").agg(F.count("*").alias("n_eligible"))
    return cohesion.join(members, "community").where((F.col("cohesion") < below) & (F.col("n_eligible") >= least)).select("community", "cohesion", "n_eligible")


def questions(g: Graph, edges: DataFrame, part: DataFrame, degree: DataFrame, cohesion: DataFrame, keep: int = QUESTIONS) -> DataFrame:
    """(pos, kind, subject): the first question of each kind, then the second of each, up to ``keep``."""
    rank = lambda df, k, kind, *order: df.orderBy(*order).limit(keep).select(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*order)).alias("row"), F.col(df.columns[0]).cast("string").alias("subject"))
    kinds = [
        rank(edges.where("confidence = 'AMBIGUOUS'").select("id"), 0, "ambiguous_edge", "id"),
        rank(bridges(edges), 1, "bridge_node", F.desc("n_communities"), F.desc("n_edges"), "id"),
        rank(inferred_hubs(g, edges, degree).join(degree.select("id", "degree"), "id"), 2, "verify_inferred", F.desc("degree"), "id"),
        rank(weak_nodes(g, degree).agg(F.min("id").alias("id")).where("id is not null"), 3, "isolated_nodes", "id"),
        rank(low_cohesion(g, part, cohesion), 4, "low_cohesion", "cohesion", "community"),
    ]
    rows = kinds[0]
    for other in kinds[1:]:
        rows = rows.unionByName(other)
    order = Window.orderBy("row", "k")
    return rows.select(F.row_number().over(order).cast("bigint").alias("pos"), "kind", "subject").where(F.col("pos") <= keep)
