"""Whole-graph metrics: degrees, PageRank, dependencies, cycles, diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshline.operators.graph import Graph, edge_weight
from meshline.session import cut

# Relations that make an import cycle.
CYCLE_RELATIONS = ("imports", "imports_from", "re_exports")
# Labels and extensions that the noise and category rules name.
BUILTIN_LABELS = ("str", "int", "float", "bool", "bytes", "list", "dict", "set", "tuple", "None", "True", "False", "Any", "Optional", "List", "Dict", "String", "Object", "Promise", "Mock", "MagicMock")
JSON_LABELS = ("name", "type", "properties", "items", "value", "version", "dependencies", "description", "id")
CODE_EXTENSIONS = ("py", "rs", "js", "jsx", "ts", "tsx", "go", "java", "c", "h", "cpp", "hpp", "cs", "swift", "rb", "php", "ex", "exs", "kt", "scala")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg")


def noise(prefix: str = ""):
    """Containers, files without an extension, built-in labels and JSON keys."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(""))
    base = F.element_at(F.split(F.replace(c("file"), F.lit("\\"), F.lit("/")), "/"), -1)
    label = F.trim(c("label"))
    return c("kind").isin("module", "file", "group") | ~F.contains(base, F.lit(".")) | label.isin(*BUILTIN_LABELS) | (F.endswith(F.lower(base), F.lit(".json")) & F.lower(label).isin(*JSON_LABELS))


def insight(prefix: str = ""):
    """Nodes that insights may name: neither noise nor rationale."""
    file_type = F.get_json_object(F.col(prefix + "metadata"), "$.file_type")
    return (F.coalesce(F.col(prefix + "kind"), F.lit("")) != "rationale") & (F.coalesce(file_type, F.lit("")) != "rationale") & ~noise(prefix)


def category(file):
    ext = F.lower(F.element_at(F.split(F.coalesce(file, F.lit("")), "\\."), -1))
    return F.when(ext.isin(*CODE_EXTENSIONS), "code").when(ext == "pdf", "paper").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("document")


def incidences(g: Graph) -> DataFrame:
    """(id, out, in, weight): one row for each end of each edge; a self-loop has two."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.when(F.col("directed"), 0).otherwise(1).alias("in")),
        F.struct(F.col("target").alias("id"), F.when(F.col("directed"), 0).otherwise(1).alias("out"), F.lit(1).alias("in")),
    )
    return g.weighted.select("weight", F.explode(ends).alias("e")).select("e.id", "e.out", "e.in", "weight")


def degree(g: Graph) -> DataFrame:
    """(id, degree, in_degree, out_degree, weighted_degree); isolated nodes have zeros."""
    per = incidences(g).groupBy("id").agg(F.count("*").alias("degree"), F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"), F.sum("weight").alias("weighted_degree"))
    return g.ids.join(per, "id", "left").na.fill(0)


def arcs(g: Graph) -> DataFrame:
    """(src, dst, weight): summed arcs, undirected edges in both orientations."""
    both = F.when(F.col("directed"), F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")))).otherwise(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"))))
    return g.weighted.select("weight", F.explode(both).alias("a")).groupBy("a.src", "a.dst").agg(F.sum("weight").alias("weight"))


def symmetric(g: Graph) -> DataFrame:
    """(a, b, weight): both orientations of every edge summed; a self-loop counts twice."""
    both = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    return g.weighted.select("weight", F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.sum("weight").alias("weight"))


def loose_weights(g: Graph) -> DataFrame:
    """(a, b, weight): each edge once as it is; those without both ends are for the reader's joins to drop."""
    return (g.edges if g.loose is None else g.loose).select(F.col("source").alias("a"), F.col("target").alias("b"), edge_weight().alias("weight"))


def halves(g: Graph) -> DataFrame:
    """(a, b, weight): what ``symmetric`` has, by the numbers of the nodes, as one row of a <= b; a self-loop counts once."""
    return g.numbered(loose_weights(g).withColumnsRenamed({"a": "source", "b": "target"})).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, int, bool]:
    """((id, rank), rounds, converged): weighted PageRank with uniform redistribution of dangling rank.

    Arcs are shuffled once, cut, and joined with the ranks of each round; the
    dangling mass of the next round and the residual come from one small aggregate.
    """
    if not 0 <= damping < 1 or tolerance <= 0 or iterations < 1:
        raise ValueError("damping must be in [0, 1), tolerance and iterations above 0")
    a = arcs(g).where("weight > 0")
    out = a.groupBy("src").agg(F.sum("weight").alias("total"))
    a = cut(a.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    n = g.nodes.count()
    if n == 0:
        return g.ids.select("id", F.lit(0.0).alias("rank")), 0, True
    dangling_flag = out.select(F.col("src").alias("id"), F.lit(False).alias("dangling"))
    ranks = cut(g.ids.join(dangling_flag, "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = ranks.where("dangling").count() / n
    for k in range(1, iterations + 1):
        base = (1 - damping + damping * lost) / n
        inflow = a.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        nxt = cut(ranks.join(inflow, "id", "left").select("id", "dangling", F.col("rank").alias("old"), (F.lit(base) + F.lit(damping) * F.coalesce("inflow", F.lit(0.0))).alias("rank")))
        told = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("residual"), F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("lost")).first()
        residual, lost = told["residual"], told["lost"] or 0.0
        ranks = nxt.drop("old")
        if residual <= tolerance:
            return ranks.select("id", "rank"), k, True
    return ranks.select("id", "rank"), iterations, False


def hubs(g: Graph, top: int = 10, by: DataFrame | None = None, score: str = "degree") -> DataFrame:
    """(rank, id, score): the highest non-noise nodes, ties by id."""
    scored = (by if by is not None else degree(g)).join(g.nodes.where(~noise()).select("id"), "id", "left_semi")
    best = scored.orderBy(F.desc(score), "id").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc(score), "id")).cast("bigint").alias("rank"), "id", F.col(score).alias("score"))


def confidence_counts(g: Graph) -> DataFrame:
    counts = g.edges.groupBy("confidence").agg(F.count("*").alias("n_edges"))
    total = counts.agg(F.sum("n_edges").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("confidence", "n_edges", (F.col("n_edges") * 100.0 / F.col("total")).alias("percent"))


def with_ends(g: Graph, *columns: str) -> DataFrame:
    """Edges with the named node columns of both ends as ``s_*`` and ``t_*``."""
    s = g.nodes.select(F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = g.nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return g.edges.join(s, "source").join(t, "target")


def file_dependencies(g: Graph) -> DataFrame:
    """(src_file, dst_file, relation, directed, n_edges, first_edge) of edges between different files, undirected pairs in order."""
    x = with_ends(g, "file").where("s_file is not null and t_file is not null and s_file <> t_file")
    a = F.when(F.col("directed"), F.col("s_file")).otherwise(F.least("s_file", "t_file"))
    b = F.when(F.col("directed"), F.col("t_file")).otherwise(F.greatest("s_file", "t_file"))
    return x.groupBy(a.alias("src_file"), b.alias("dst_file"), "relation", "directed").agg(F.count("*").alias("n_edges"), F.min("id").alias("first_edge"))


def strongly_connected(links: DataFrame) -> DataFrame:
    """(id, component) of every node on a directed cycle of ``links`` (src, dst); the component is its smallest id.

    Nodes without a predecessor or successor among the rest are trimmed until
    none is left. Then colours spread forward (each node takes the smallest id
    that reaches it), and a colour's component is what its root's backward walk
    reaches within the colour; both rest on joins, and found nodes leave.
    """
    left = cut(links.where("src is not null and dst is not null").select("src", "dst").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("id"))
    left = cut(left.where("src <> dst"))
    found = None
    while True:
        before = left.count()
        while before:
            left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
            after = left.count()
            if after == before:
                break
            before = after
        if not before:
            break
        ids = left.select(F.col("src").alias("id")).distinct()
        colour = cut(ids.withColumn("c", F.col("id")))
        while True:
            into = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            nxt = cut(colour.join(into, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
            moved = nxt.where("c <> old").limit(1).count()
            colour = nxt.select("id", "c")
            if not moved:
                break
        same = cut(left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("ct")), "dst").where("cs = ct").select("src", "dst", F.col("cs").alias("c")))
        reach = cut(colour.where("id = c"))
        front = reach
        while True:
            back = same.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct().join(reach.select("id"), "id", "left_anti")
            front = cut(back)
            if not front.limit(1).count():
                break
            reach = cut(reach.unionByName(front))
        members = reach.join(reach.groupBy("c").count().where("count > 1").select("c"), "c", "left_semi").select("id", F.col("c").alias("component"))
        found = members if found is None else found.unionByName(members)
        found = cut(found)
        left = cut(left.join(reach.select(F.col("id").alias("src")), "src", "left_anti").join(reach.select(F.col("id").alias("dst")), "dst", "left_anti"))
    alone = loops.select("id", F.col("id").alias("component"))
    if found is None:
        return alone
    return found.unionByName(alone.join(found.select("id"), "id", "left_anti"))


def import_cycles(g: Graph) -> DataFrame:
    """(component, file, n_files): files on an import cycle."""
    x = with_ends(g, "file").where(F.col("relation").isin(*CYCLE_RELATIONS) & F.col("s_file").isNotNull() & F.col("t_file").isNotNull())
    links = x.select(F.col("s_file").alias("src"), F.col("t_file").alias("dst"))
    back = x.where("not directed").select(F.col("t_file").alias("src"), F.col("s_file").alias("dst"))
    scc = cut(strongly_connected(links.unionByName(back)))
    return scc.join(scc.groupBy("component").agg(F.count("*").alias("n_files")), "component").select("component", F.col("id").alias("file"), "n_files")


def pair_diagnosis(g: Graph) -> DataFrame:
    """One row (metric, value): what a simple graph would lose of this multigraph."""
    e = g.edges.select("source", "target", "relation", "directed", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(-1)).alias("l"), "confidence")
    kinds = e.agg(F.count("*").alias("edges"), F.count_if("directed").alias("directed"), F.count_if(~F.col("directed")).alias("undirected"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"))
    ordered = e.groupBy("source", "target").count().agg(F.sum(F.col("count") - 1).alias("ordered_collapse_loss"))
    pairs = e.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("relation").alias("r"), F.count_distinct("directed").alias("d"))
    unordered = pairs.agg(F.sum(F.col("n") - 1).alias("unordered_collapse_loss"), F.count_if(F.col("d") > 1).alias("mixed_direction_pairs"), F.count_if(F.col("r") > 1).alias("relation_variant_pairs"))
    kind = F.when(F.col("directed"), F.concat_ws("\u0001", "source", "target")).otherwise(F.concat_ws("\u0001", "a", "b"))
    parallel = e.groupBy("directed", kind.alias("k")).count().where("count > 1").agg(F.count("*").alias("parallel_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("parallel_extras"))
    same = e.groupBy("source", "target", "relation", "directed", "f", "l", "confidence").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_records"))
    wide = kinds.crossJoin(ordered).crossJoin(unordered).crossJoin(parallel).crossJoin(same)  # one row each
    names = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("value")) for c in names])).alias("m")).select("m.*")


def stats(g: Graph, refs: DataFrame) -> DataFrame:
    """(metric, value): counts of nodes, edges, files, kinds, relations and unresolved references."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("files"), F.count_distinct("kind").alias("kinds"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))
    r = refs.agg(F.count("*").alias("references"), F.count_if(F.col("resolved_target").isNull()).alias("unresolved"))
    wide = n.crossJoin(e).crossJoin(r)  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def topics(g: Graph, keep: int = 8, of: int = 64) -> DataFrame:
    """(rank, label): labels of the highest-degree nodes that are no containers, sanitised and distinct without case."""
    top = degree(g).join(g.nodes.where(~F.col("kind").isin("module", "file", "group", "package", "section")).select("id", "label"), "id").orderBy(F.desc("degree"), "id").limit(of)
    clean = top.withColumn("label", F.trim(F.regexp_replace("label", "[^\\p{L}\\p{N}_ .-]+", " "))).where("label <> ''")
    first = clean.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("label")).orderBy(F.desc("degree"), "id"))).where("n = 1")
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("bigint")).where(F.col("rank") <= keep).select("rank", "label")


def snapshot_sizes(g: Graph, refs: DataFrame) -> DataFrame:
    """(record, n_rows, n_bytes): rows of each table of a snapshot and the bytes of their names and metadata."""
    def one(record: str, df: DataFrame, *columns: str) -> DataFrame:
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
        return df.agg(F.lit(record).alias("record"), F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))

    nodes, edges = one("nodes", g.nodes, "id", "label", "qualified_name", "file", "metadata"), one("edges", g.edges, "id", "source", "target", "relation", "metadata")
    return nodes.unionByName(edges).unionByName(one("refs", refs, "id", "source", "label", "relation"))


def bounded_snapshot(g: Graph, refs: DataFrame, most_nodes: int, most_edges: int, most_refs: int, most_bytes: int) -> tuple[Graph, DataFrame]:
    """The graph and its refs, after their sizes were found within the bounds; else an error that names the first bound broken."""
    sizes = {r["record"]: (r["n_rows"], r["n_bytes"]) for r in snapshot_sizes(g, refs).collect()}
    for record, most in (("nodes", most_nodes), ("edges", most_edges), ("refs", most_refs)):
        if sizes[record][0] > most:
            raise ValueError(f"{sizes[record][0]} {record}; the bound is {most}")
    total = sum(b for _, b in sizes.values())
    if total > most_bytes:
        raise ValueError(f"{total} bytes; the bound is {most_bytes}")
    return g, refs
