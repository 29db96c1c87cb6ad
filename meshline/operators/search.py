"""Text search over nodes: postings, exact lookups, ranked seeds and endpoint tiers, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshline.functions import text as tx

MOST_QUERIES = 1_000
TEXT_BYTES = 1_024
SEEDS = 3
CUTOFF = 0.2
EXACT_ROWS = 21


def postings(nodes: DataFrame) -> DataFrame:
    """(token, id): each folded token of a node's search text, once per node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, i) for i, label, q, f, m in zip(b["id"], b["label"], b["qualified_name"], b["file"], b["metadata"], strict=True) for t in tx.tokens(tx.search_text(i, label, q, f, m))]
            yield pd.DataFrame(out, columns=["token", "id"])

    return nodes.select("id", "label", "qualified_name", "file", "metadata").mapInPandas(run, "token string, id string")


def _normalized(nodes: DataFrame) -> DataFrame:
    """(id, label_norm, id_norm, qname_norm, prose_norm): folded once, where rows are narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prose = [" ".join(str(a[f]) for f in tx.PROSE_FIELDS if isinstance(a.get(f), str)) for a in map(tx.attributes, b["metadata"])]
            yield pd.DataFrame({"id": b["id"], "label_norm": b["label"].map(lambda x: tx.normalize(x or "")), "id_norm": b["id"].map(tx.normalize), "qname_norm": b["qualified_name"].map(lambda x: tx.normalize(x or "")), "prose_norm": [tx.normalize(p) for p in prose]})

    return nodes.select("id", "label", "qualified_name", "metadata").mapInPandas(run, "id string, label_norm string, id_norm string, qname_norm string, prose_norm string")


def check_text(text: str) -> str:
    flat = text.strip()
    if not flat or len(flat.encode()) > TEXT_BYTES:
        raise ValueError(f"a query text must have 1 to {TEXT_BYTES} bytes")
    return flat


def term_table(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(query, n_terms, ord, term, p): the terms of at most MOST_QUERIES queries; ``p`` is the prefix that finds postings."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once")
    rows = []
    for q in dict.fromkeys(map(check_text, queries)):
        terms = [tx.normalize(t) for t in tx.search_terms(q)]
        rows += [(q, len(terms), k, t, t[:3]) for k, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query string, n_terms int, ord int, term string, p string")


def scores(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """(query, ord, term, n_terms, id, label_norm, label_size, w, covered): the weight of each term in each node it is a prefix in.

    Only postings that start with one of the terms' prefixes are kept before the
    join, and the join is on that prefix.
    """
    spark = nodes.sparkSession
    terms = term_table(spark, queries)
    sizes = sorted({len(r["p"]) for r in terms.select("p").distinct().collect()})
    posts = postings(nodes)
    hits = None
    for n in sizes:
        part = terms.where(F.length("p") == n)
        mine = [r["p"] for r in part.select("p").distinct().collect()]
        found = posts.withColumn("p", F.substring("token", 1, n)).where(F.col("p").isin(*mine)).join(F.broadcast(part), "p").where(F.startswith("token", "term")).select("query", "ord", "term", "n_terms", "id").distinct()
        hits = found if hits is None else hits.unionByName(found)
    rich = hits.join(_normalized(nodes), "id").join(nodes.select("id", F.octet_length("label").alias("label_size")), "id")
    bare = F.regexp_replace("label_norm", "(\\(\\))+$", "")
    word = F.array_contains(F.split(bare, "[^\\p{L}\\p{N}]+"), F.col("term"))
    w = (
        F.when((bare == F.col("term")) | (F.col("id_norm") == F.col("term")), 12.0).when(word, 8.0).when(F.startswith(bare, "term"), 6.0)
        .when(F.contains(bare, "term"), 3.0).when(F.contains("qname_norm", "term"), 2.0).when(F.contains("prose_norm", "term"), 1.5).otherwise(1.0)
    )
    return rich.select("query", "ord", "term", "n_terms", "id", "label_norm", "label_size", w.alias("w"), F.contains("label_norm", "term").cast("int").alias("covered"))


def ranked(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """(query, id, score): sum of term weights times one plus the squared share of terms in the label."""
    s = scores(nodes, queries)
    total = s.groupBy("query", "id", "n_terms").agg(F.sum("w").alias("w"), F.sum("covered").alias("c"))
    share = F.col("c") / F.col("n_terms")
    return total.select("query", "id", (F.col("w") * (1 + share * share)).alias("score"))


def seeds(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """(query, pos, id, score): the seeds of each query in order.

    An exact match of an id, else of a label, qualified name or file, decides
    alone. Otherwise up to SEEDS nodes with different labels and a score of at
    least CUTOFF of the best (ties: shorter label, then id), then for each term
    its best node if neither it nor its label is among them.
    """
    exact = exact_lookup(nodes, queries)
    s = scores(nodes, queries)
    known = s.groupBy("query", "id", "n_terms", "label_norm", "label_size").agg(F.sum("w").alias("w"), F.sum("covered").alias("c"))
    share = F.col("c") / F.col("n_terms")
    known = known.withColumn("score", F.col("w") * (1 + share * share))
    best = known.groupBy("query", "label_norm").agg(F.min(F.struct((-F.col("score")).alias("neg"), "label_size", "id")).alias("b")).select("query", "label_norm", (-F.col("b.neg")).alias("score"), "b.label_size", "b.id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "label_size", "id")
    top = best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SEEDS)
    cut = top.groupBy("query").agg(F.max("score").alias("most"))
    top = top.join(cut, "query").where(F.col("score") >= CUTOFF * F.col("most")).select("query", F.lit(0).alias("stage"), F.col("rn").alias("ord"), "id", "label_norm", "score")
    per = s.groupBy("query", "ord").agg(F.min(F.struct((-F.col("w")).alias("neg"), "id", "label_norm")).alias("b")).select("query", F.lit(1).alias("stage"), "ord", "b.id", "b.label_norm", (-F.col("b.neg")).alias("score"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out, ids, labels = [], set(), set()
        for r in pdf.sort_values(["stage", "ord"]).itertuples():
            if r.id not in ids and r.label_norm not in labels:
                out.append((r.query, len(out), r.id, r.score))
                ids.add(r.id)
                labels.add(r.label_norm)
        return pd.DataFrame(out, columns=["query", "pos", "id", "score"])

    # at most SEEDS + 8 rows a query reach this group
    chosen = top.unionByName(per).groupBy("query").applyInPandas(lambda pdf: pick(pdf), "query string, pos int, id string, score double")
    sure = exact.select("query", (F.row_number().over(Window.partitionBy("query").orderBy("id")) - 1).alias("pos"), "id", F.lit(None).cast("double").alias("score"))
    return sure.unionByName(chosen.join(exact.select("query").distinct(), "query", "left_anti"))


def exact_lookup(nodes: DataFrame, queries: list[str], allow_file: bool = True) -> DataFrame:
    """(query, tier, id): nodes whose id is the text (tier 0), else whose label, qualified name or file is; EXACT_ROWS a query by id."""
    wanted = [check_text(q) for q in queries]
    columns = ["label", "qualified_name", *(["file"] if allow_file else [])]
    by_id = nodes.where(F.col("id").isin(*wanted)).select(F.col("id").alias("query"), F.lit(0).alias("tier"), "id")
    by_name = nodes.select("id", F.explode(F.array_distinct(F.array(*columns))).alias("query")).where(F.col("query").isin(*wanted)).select("query", F.lit(1).alias("tier"), "id").distinct()
    both = by_id.unionByName(by_name.join(by_id.select("query"), "query", "left_anti"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where(F.col("rn") <= EXACT_ROWS).drop("rn")


def unique_or_error(found: list[str], text: str) -> str:
    if not found:
        raise LookupError(f"no node matches {text!r}")
    if len(found) > 1:
        raise LookupError(f"{text!r} is ambiguous, use an exact id: {', '.join(sorted(found))}")
    return found[0]


def endpoint_tiers(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """(query, tier, n, id): the first tier with any node: 0 equal names (with or without ``()``), 1 a qualified tail, 2 a prefix, 3 a substring.

    ``id`` is the node if it is the only one at that tier, else null.
    """
    spark = nodes.sparkSession
    q = spark.createDataFrame([(x, tx.normalize(check_text(x))) for x in queries], "query string, q string")
    n = _normalized(nodes).select("id", "id_norm", "label_norm", "qname_norm")
    bare = lambda c: F.regexp_replace(c, "\\(\\)$", "")
    tail = F.endswith("qname_norm", F.concat(F.lit("."), F.col("q"))) | F.endswith("qname_norm", F.concat(F.lit(" "), F.col("q")))
    tier = (
        F.when((bare(F.col("label_norm")) == bare(F.col("q"))) | (F.col("id_norm") == F.col("q")) | (bare(F.col("qname_norm")) == bare(F.col("q"))), 0).when(tail, 1)
        .when(F.startswith("label_norm", "q") | F.startswith("qname_norm", "q"), 2).when(F.contains("label_norm", "q") | F.contains("qname_norm", "q"), 3)
    )
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at once")
    hits = n.join(F.broadcast(q), F.contains("label_norm", bare(F.col("q"))) | F.contains("qname_norm", bare(F.col("q"))) | (F.col("id_norm") == F.col("q"))).withColumn("tier", tier).where("tier is not null")
    per = hits.groupBy("query", "tier").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    least = per.groupBy("query").agg(F.min(F.struct("tier", "n", "first")).alias("b"))
    return least.select("query", "b.tier", "b.n", F.when(F.col("b.n") == 1, F.col("b.first")).alias("id"))
