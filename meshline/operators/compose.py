"""Composition of graphs: namespaced union, package links, cross-graph references, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.operators.graph import Graph


def namespaced(project: str, column):
    """Id of a record in a composed graph: the prefix ``project:`` and the JSON list of project and id."""
    return F.when(column.isNotNull(), F.concat(F.lit("project:"), F.to_json(F.array(F.lit(project), column))))


def provenance(project: str, id_, metadata):
    return F.to_json(F.struct(F.lit(project).alias("project"), id_.alias("original_id"), F.parse_json(F.coalesce(metadata, F.lit("{}"))).alias("original_metadata")))


def merge(graphs: dict[str, Graph]) -> Graph:
    """Union of named graphs; nothing is collapsed, every record keeps its project and original metadata."""
    if not graphs or any(not n for n in graphs):
        raise ValueError("every graph needs a nonempty name")
    nodes, edges = [], []
    for name, g in graphs.items():
        nodes.append(g.nodes.withColumn("metadata", provenance(name, F.col("id"), F.col("metadata"))).withColumn("id", namespaced(name, F.col("id"))).withColumn("project", F.lit(name)))
        e = g.edges.withColumn("metadata", provenance(name, F.col("id"), F.col("metadata")))
        for c in ("id", "source", "target"):
            e = e.withColumn(c, namespaced(name, F.col(c)))
        edges.append(e.withColumn("project", F.lit(name)))
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def _package_claims(nodes: DataFrame, key: str, project: str) -> DataFrame:
    k = F.col(key)
    named = k.rlike("^package:[^:]+:.+") & ~k.rlike("\\s")
    return nodes.where((F.col("kind") == "package") & named & F.col(project).isNotNull() & F.col("id").isNotNull()).select(k.alias("key"), "id", F.col(project).alias("project")).distinct()


def package_classes(nodes: DataFrame, key: str = "binding_key", project: str = "project") -> DataFrame:
    """(key, id, project, n_links): package nodes whose key another project claims, each with its number of links.

    The links of a key join all pairs of its nodes in different projects; class
    and counts say the same in one row a node: all nodes of the key less those
    of the own project. Keys read ``package:ecosystem:name`` without white space.
    """
    claims = _package_claims(nodes, key, project)
    total = claims.groupBy("key").agg(F.count("*").alias("n"))
    own = claims.groupBy("key", "project").agg(F.count("*").alias("own"))
    return claims.join(own, ["key", "project"]).join(total, "key").where("n > own").select("key", "id", "project", (F.col("n") - F.col("own")).alias("n_links"))


def link_packages(nodes: DataFrame, key: str = "binding_key", project: str = "project") -> DataFrame:
    """(key, a, b), a < b: undirected ``same_package`` links, one for each pair of a key's nodes in different projects.

    The output has one row a pair, which is what composed graphs store; where
    many projects share a package, ``package_classes`` says the same without
    pairs. Nodes of keys that one project alone claims are dropped before the
    join.
    """
    claims = package_classes(nodes, key, project)
    one = claims.select("key", F.col("id").alias("a"), F.col("project").alias("pa"))
    other = claims.select("key", F.col("id").alias("b"), F.col("project").alias("pb"))
    return one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb"))).select("key", "a", "b")


def link_references(refs: DataFrame, keys: DataFrame, owner: DataFrame) -> DataFrame:
    """(ref_id, target, key): unbound refs whose first answered key has one node, in another project.

    Any local or ambiguous match at an earlier key blocks the later ones.
    """
    claims = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    asked = refs.where("resolved_target is null").select(F.col("id").alias("ref_id"), "repo", F.posexplode("candidate_keys").alias("p", "key")).where("key is not null")
    hit = asked.join(claims, "key").groupBy("ref_id", "repo").agg(F.min(F.struct("p", "key", "n", "node_id")).alias("h"))
    sure = hit.where("h.n = 1").select("ref_id", "repo", "h.key", F.col("h.node_id").alias("target"))
    return sure.join(owner.select(F.col("id").alias("target"), F.col("repo").alias("owner")), "target").where(~F.col("repo").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull()).select("ref_id", "target", "key")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, fingerprint) that does not depend on the order of the rows: their number and sums of pieces of their digests."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns])
    h = df.select(F.sha2(text, 256).alias("h")).select(*[F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"d{k}") for k in range(4)])
    sums = h.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"d{k}"), F.lit(0)).alias(f"d{k}") for k in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *[f"d{k}" for k in range(4)]), 256).alias("fingerprint"))
