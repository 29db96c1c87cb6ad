"""The current property graph of the driver's tables: nodes with stubs, edges with both ends present."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.session import cut, positions, table
from meshline.tables import current_rows

NODE_COLUMNS = ["id", "label", "kind", "file", "line", "end_line", "qualified_name", "binding_key", "metadata", "repo"]
EDGE_COLUMNS = ["id", "source", "target", "relation", "directed", "file", "line", "confidence", "metadata", "ref_id"]


def edge_weight(metadata: str = "metadata"):
    """Weight of an edge: ``metadata.weight`` or 1; what is no finite number of at least 0 raises an error."""
    raw = F.get_json_object(metadata, "$.weight")
    value = raw.try_cast("double")
    bad = raw.isNotNull() & (value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")))
    return F.when(bad, F.raise_error(F.concat(F.lit("edge weight must be a finite number of at least 0: "), raw)).cast("double")).otherwise(F.coalesce(value, F.lit(1.0)))


@dataclass
class Graph:
    """Nodes and edges of one snapshot. Tables stay lazy; only the columns an operator names are read.

    ``loose`` are the edges before those without both ends are dropped, where that is a step of its own.
    """

    nodes: DataFrame
    edges: DataFrame
    loose: DataFrame | None = None

    @cached_property
    def ids(self) -> DataFrame:
        return self.nodes.select("id")

    @cached_property
    def numbers(self) -> DataFrame:
        """(id, n): the rank of each id. Loops over many rounds shuffle these numbers and not the texts."""
        return cut(positions(cut(self.ids.where("id is not null").distinct()), "id", "n"))

    def numbered(self, edges: DataFrame) -> DataFrame:
        """``edges`` with numbers as source and target; edges without both ends are dropped."""
        for end in ("source", "target"):
            edges = edges.join(self.numbers.select(F.col("id").alias(end), F.col("n").alias("_n")), end).drop(end).withColumnRenamed("_n", end)
        return edges

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with ids for the numbers in ``columns``."""
        shown = rows.columns
        for c in columns:
            rows = rows.withColumnRenamed(c, "_n").join(self.numbers.select(F.col("n").alias("_n"), F.col("id").alias(c)), "_n").drop("_n")
        return rows.select(*shown)

    @cached_property
    def weighted(self) -> DataFrame:
        """(id, source, target, relation, directed, confidence, weight)."""
        return self.edges.select("id", "source", "target", "relation", "directed", "confidence", edge_weight().alias("weight"))


def _upto(columns: list[str], wanted: tuple[str, ...]) -> list[str]:
    """The shortest front of ``columns`` that holds ``wanted``: the row that is current is the same by it as by all of them."""
    return columns[: 1 + max(columns.index(c) for c in wanted)] if wanted else columns


def current_graph(spark: SparkSession, d: str, node_columns: tuple[str, ...] = (), edge_columns: tuple[str, ...] = ()) -> Graph:
    """Current rows that are not deleted, stubs included; relations in one spelling; dangling edges dropped.

    Columns may be named, then only they and those before them are read.
    """
    of_nodes, of_edges = _upto(NODE_COLUMNS, node_columns), _upto(EDGE_COLUMNS, edge_columns and ("directed", *edge_columns))
    nodes = current_rows(table(spark, d, "nodes"), "id", ["generation", "deleted", *of_nodes[1:]])
    nodes = nodes.where(~F.coalesce("deleted", F.lit(False))).select(*of_nodes)
    stubs = table(spark, d, "stubs").select(*[c for c in ("id", "label", "kind", "binding_key") if c in of_nodes])
    nodes = nodes.unionByName(stubs, allowMissingColumns=True)
    loose = current_rows(table(spark, d, "edges"), "id", ["generation", *of_edges[1:]]).select(*of_edges)
    loose = loose.withColumn("relation", F.lower(F.trim("relation"))).withColumn("directed", F.coalesce("directed", F.lit(True)))
    ids = nodes.select("id")
    edges = loose.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges.select(*of_edges), loose)


SQL = """
gn AS (SELECT id, label, kind, file, line, end_line, qualified_name, binding_key, metadata, repo FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC, indexed_at DESC) AS rn FROM nodes) WHERE rn = 1 AND NOT coalesce(deleted, false)
  UNION ALL SELECT id, label, kind, NULL, NULL, NULL, NULL, binding_key, NULL, NULL FROM stubs),
ge AS (SELECT id, source, target, lower(trim(relation)) AS relation, coalesce(directed, true) AS directed, file, line, confidence, metadata, ref_id, coalesce(CAST(json_extract_string(metadata, '$.weight') AS DOUBLE), 1.0) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC, indexed_at DESC) AS rn FROM edges) WHERE rn = 1 AND source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC, indexed_at DESC) AS rn FROM refs) WHERE rn = 1)
"""
