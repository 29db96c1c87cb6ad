"""Lookups without ranking: prefix search, the root node of a file, and relation names by shorthand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshline.functions import text as tx
from meshline.operators.graph import Graph
from meshline.operators.search import check_text, exact_lookup, postings
from meshline.operators.traverse import MOST_SEEDS, Options, Result, adjacency, explore

MOST_TERMS = 8
ROOT_KINDS = ("file", "module")


def basic_search(nodes: DataFrame, queries: list[str], most: int = MOST_SEEDS) -> DataFrame:
    """(query, pos, id, truncated): exact matches of a text, else nodes with a token that starts with one of its words.

    Nothing is ranked: the first ``most`` nodes by id, and whether there were
    more. A text without a word, or with more than MOST_TERMS, is an error.
    """
    rows = []
    for q in dict.fromkeys(map(check_text, queries)):
        words = [w for w in re.split(r"[\W_]+", q) if w]
        if not 1 <= len(words) <= MOST_TERMS:
            raise ValueError(f"a query needs 1 to {MOST_TERMS} words")
        rows += [(q, t, t[:3]) for t in dict.fromkeys(map(tx.normalize, words))]
    terms = nodes.sparkSession.createDataFrame(rows, "query string, term string, p string")
    exact = exact_lookup(nodes, queries).select("query", "id")
    hits = None
    for n in sorted({len(p) for *_, p in rows}):
        mine = terms.where(F.length("p") == n)
        found = postings(nodes).withColumn("p", F.substring("token", 1, n)).join(F.broadcast(mine), "p").where(F.startswith("token", "term")).select("query", "id")
        hits = found if hits is None else hits.unionByName(found)
    both = exact.unionByName(hits.distinct().join(exact.select("query").distinct(), "query", "left_anti"))
    first = both.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where(F.col("pos") <= most + 1)
    truncated = first.groupBy("query").agg((F.max("pos") > most).alias("truncated"))
    return first.where(F.col("pos") <= most).join(truncated, "query").select("query", (F.col("pos") - 1).alias("pos"), "id", "truncated")


def file_roots(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, id, n_nodes, n_roots): the one node that stands for a file.

    A root is a file or module node, or one on line 1 that is labelled with the
    file's base name. ``id`` is the only root, or the only node where there is no
    root; null where the file has several of them or no node at all.
    """
    base = F.element_at(F.split(F.col("file"), "/"), -1)
    root = F.col("kind").isin(*ROOT_KINDS) | F.coalesce((F.col("line") == 1) & (F.col("label") == base), F.lit(False))
    per = nodes.where("file is not null").groupBy("file").agg(
        F.count("*").alias("n_nodes"), F.count_if(root).alias("n_roots"), F.min(F.when(root, F.col("id"))).alias("root"), F.min("id").alias("only"),
    )
    asked = files.select("file").where("file is not null").distinct().join(per, "file", "left").na.fill(0, ["n_nodes", "n_roots"])
    sole = F.when(F.col("n_roots") == 1, F.col("root")).when((F.col("n_roots") == 0) & (F.col("n_nodes") == 1), F.col("only"))
    return asked.select("file", sole.alias("id"), "n_nodes", "n_roots")


def incident_relations(g: Graph, refs: DataFrame | None, direction: str = "both") -> DataFrame:
    """(id, relation): relations of each node's edges in a direction and, unless it is incoming, of its unbound references."""
    out = adjacency(g, direction).select("id", "relation")
    if refs is not None and direction != "incoming":
        out = out.unionByName(refs.where("resolved_target is null").select(F.col("source").alias("id"), "relation"))
    return out.where("id is not null and relation is not null").distinct()


def resolve_relations(asked: DataFrame, incident: DataFrame) -> DataFrame:
    """(id, text, relation, n): the relation that a shorthand names at each asked (id, text).

    The relation itself, else the only one that is equal when folded, else
    begins with the folded text, else holds it. ``n`` is the number of relations
    at the deciding tier; more than one is ambiguous and gives null, none leaves
    the text, so that an unmatched filter stays restrictive.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, name = b["text"].map(lambda x: tx.normalize(x.strip())), b["relation"].map(tx.normalize)
            tier = [0 if a == c else 1 if d == t else 2 if d.startswith(t) else 3 if t in d else -1 for a, c, t, d in zip(b["text"], b["relation"], text, name, strict=True)]
            yield b.assign(tier=[k if t or k == 0 else -1 for k, t in zip(tier, text, strict=True)])

    wanted = asked.select("id", "text").where("id is not null and text is not null").distinct()
    hits = wanted.join(incident, "id").mapInPandas(fold, "id string, text string, relation string, tier int").where("tier >= 0")
    per = hits.groupBy("id", "text", "tier").agg(F.count("*").alias("n"), F.min("relation").alias("first"))
    least = per.groupBy("id", "text").agg(F.min(F.struct("tier", "n", "first")).alias("b"))
    sole = F.when(F.col("b").isNull(), F.col("text")).when(F.col("b.n") == 1, F.col("b.first"))
    return wanted.join(least, ["id", "text"], "left").select("id", "text", sole.alias("relation"), F.coalesce("b.n", F.lit(0)).alias("n"))


def neighbors_by_shorthand(g: Graph, refs: DataFrame | None, seed: str, relation: str, o: Options | None = None) -> Result:
    """Bounded exploration from one node along the relation that a shorthand names there; an ambiguous one is an error."""
    o = o or Options()
    one = g.nodes.sparkSession.createDataFrame([(seed, relation)], "id string, text string")
    near = incident_relations(Graph(g.nodes, g.edges.where((F.col("source") == seed) | (F.col("target") == seed))), refs and refs.where(F.col("source") == seed), o.direction)
    found = resolve_relations(one, near).first()
    if found["relation"] is None:
        raise LookupError(f"relation {relation!r} names {found['n']} relations, use an exact one")
    return explore(g, [seed], Options(**{**vars(o), "relations": (found["relation"],)}), refs=refs)
