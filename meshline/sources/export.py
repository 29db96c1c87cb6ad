"""Sinks: graphs as JSON, GraphML, Cypher, Mermaid, canvas and tree rows; a guarded writer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshline.operators.graph import Graph
from meshline.session import positions
from meshline.streaming.refresh import Generations

CALL_FLOW = ("calls", "calls_method", "uses", "imports", "imports_from", "re_exports")


def snapshot_rows(g: Graph) -> DataFrame:
    """(record, id, json): each record as one JSON text, lossless, nulls included."""
    full = {"ignoreNullFields": "false"}
    n = g.nodes.select(F.lit("node").alias("record"), "id", F.to_json(F.struct(*sorted(g.nodes.columns)), full).alias("json"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("record"), "id", F.to_json(F.struct(*sorted(g.edges.columns)), full).alias("json")))


def node_link_rows(g: Graph) -> DataFrame:
    """(record, json) in the node-link layout, edges with their own direction and ``_src``/``_tgt``; ``original`` holds the whole record."""
    full = {"ignoreNullFields": "false"}
    whole = lambda df: F.struct(*sorted(df.columns)).alias("original")
    n = g.nodes.select(F.lit("node").alias("record"), F.to_json(F.struct("id", "label", F.col("kind").alias("file_type"), F.col("file").alias("source_file"), whole(g.nodes)), full).alias("json"))
    e = g.edges.select(F.lit("link").alias("record"), F.to_json(F.struct("source", "target", F.col("id").alias("key"), "relation", "confidence", "directed", F.col("source").alias("_src"), F.col("target").alias("_tgt"), whole(g.edges)), full).alias("json"))
    return n.unionByName(e)


def cypher_rows(g: Graph) -> DataFrame:
    """(statement): MERGE statements, nodes and then edges."""
    q = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\\\", "\\\\\\\\"), "'", "\\\\'"), "\n", "\\\\n"), F.lit("'"))
    n = g.nodes.select(F.concat(F.lit("MERGE (n:Node {id: "), q("id"), F.lit("}) SET n.label = "), q("label"), F.lit(", n.kind = "), q("kind"), F.lit(";")).alias("statement"))
    e = g.edges.select(F.concat(F.lit("MATCH (a:Node {id: "), q("source"), F.lit("}), (b:Node {id: "), q("target"), F.lit("}) MERGE (a)-[r:EDGE {id: "), q("id"), F.lit("}]->(b) SET r.relation = "), q("relation"), F.lit(";")).alias("statement"))
    return n.unionByName(e)


def _xml(c: str):
    """Escaped text; characters that XML cannot hold are an error."""
    text = F.coalesce(F.col(c), F.lit(""))
    bad = text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.when(bad, F.raise_error(F.lit("a control character that XML cannot hold")).cast("string")).otherwise(text)


def graphml_rows(g: Graph) -> DataFrame:
    """(record, xml); a control character that XML cannot hold fails the row."""
    n = g.nodes.select(F.lit("node").alias("record"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="label">'), _xml("label"), F.lit("</data></node>")).alias("xml"))
    e = g.edges.select(F.lit("edge").alias("record"), F.concat(F.lit('<edge id="'), _xml("id"), F.lit('" source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('" directed="'), F.col("directed").cast("string"), F.lit('"><data key="relation">'), _xml("relation"), F.lit("</data></edge>")).alias("xml"))
    return n.unionByName(e)


def _entities(c: str):
    """Text with every character that is no ASCII letter or digit as a numbered entity."""
    chars = F.split(F.coalesce(F.col(c), F.lit("")), "")
    return F.array_join(F.transform(chars, lambda x: F.when(x.rlike("^[A-Za-z0-9]?$"), x).otherwise(F.concat(F.lit("#"), F.ascii(x).cast("string"), F.lit(";")))), "")


def mermaid_rows(g: Graph) -> DataFrame:
    """(line) of a flow chart; every character that is no letter or digit is an entity."""
    name = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 16))
    n = g.nodes.select(F.concat(F.lit("  "), name(F.col("id")), F.lit('["'), _entities("label"), F.lit('"]')).alias("line"))
    e = g.edges.select(F.concat(F.lit("  "), name(F.col("source")), F.when(F.col("directed"), F.lit(" -->|")).otherwise(F.lit(" ---|")), _entities("relation"), F.lit("| "), name(F.col("target"))).alias("line"))
    return n.unionByName(e)


def layout(g: Graph) -> DataFrame:
    """(id, x, y) on a circle in id order; its radius grows with the number of nodes."""
    n = g.nodes.count()
    radius = max(22 * n, 640) / 2 - 100
    spots = positions(g.nodes, "id", "k")
    angle = F.col("k") * F.lit(2 * math.pi / max(1, n))
    return spots.select("id", (F.lit(radius) * F.cos(angle)).alias("x"), (F.lit(radius) * F.sin(angle)).alias("y"))


def edge_ordinals(g: Graph) -> DataFrame:
    """(id, ordinal): position of an edge among those of its unordered pair, by id."""
    w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("id")
    return g.edges.select("id", "source", "target").withColumn("ordinal", F.row_number().over(w)).select("id", "ordinal")


def canvas(part: DataFrame, columns: int = 4, width: int = 330, height: int = 240) -> DataFrame:
    """(id, community, x, y): cards in rows of four within each community, by id."""
    k = F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1
    return part.withColumn("k", k).select("id", "community", (F.col("k") % columns * width).cast("int").alias("x"), (F.floor(F.col("k") / columns) * height).cast("int").alias("y"))


def source_tree(g: Graph) -> DataFrame:
    """(file, n_nodes, first, last): the nodes of each file in the order of line, label and id."""
    s = F.struct(F.coalesce("line", F.lit(0)).alias("line"), "label", "id")
    return g.nodes.where("file is not null").groupBy("file").agg(F.count("*").alias("n_nodes"), F.min(s)["id"].alias("first"), F.max(s)["id"].alias("last"))


def call_flow(g: Graph) -> DataFrame:
    """(file, relation, n_edges): recorded call flow by the file of the source."""
    e = g.edges.where(F.col("relation").isin(*CALL_FLOW)).join(g.nodes.where("file is not null").select(F.col("id").alias("source"), F.col("file").alias("s_file")), "source")
    return e.groupBy(F.col("s_file").alias("file"), "relation").agg(F.count("*").alias("n_edges"))


def guarded_write(g: Graph, path: str, allow_shrink: bool = False) -> dict[str, int]:
    """Write nodes and edges as the next generation below ``path`` and report the counts; a graph does not shrink unless told to.

    Both tables go to one new folder, and one pointer makes both current, so a
    reader never sees the nodes of one graph with the edges of another; earlier
    generations stay as backups. Only a root without any generation counts as
    empty; whatever else fails is raised.
    """
    store = Generations(g.nodes.sparkSession, path)
    base = store.state()["generation"]
    out = {"nodes": g.nodes.count(), "edges": g.edges.count()}
    before = read_written(g.nodes.sparkSession, path) if base else None
    for name, df in (("nodes", before.nodes), ("edges", before.edges)) if before else ():
        was = df.count()
        if was > out[name] and not allow_shrink:
            raise ValueError(f"{name} would shrink from {was} to {out[name]}")
    both = [df.select(F.lit(name).alias("_table"), F.struct(*df.columns).alias(name)) for name, df in (("nodes", g.nodes), ("edges", g.edges))]
    store.publish(both[0].unionByName(both[1], allowMissingColumns=True), base)
    return out


def read_written(spark: SparkSession, path: str, generation: int | None = None) -> Graph:
    """The current, or an earlier, generation that ``guarded_write`` made."""
    rows = Generations(spark, path).read(generation)
    if rows is None:
        raise FileNotFoundError(f"no generation below {path}")
    return Graph(rows.where("_table = 'nodes'").select("nodes.*"), rows.where("_table = 'edges'").select("edges.*"))
