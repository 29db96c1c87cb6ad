"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.session import cut


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node reaches over undirected ``links`` (a, b).

    A round gives each node the smallest label among its neighbours, then the
    smallest that any node of its old label got, so whole parts merge at once,
    or the label of its label, so chains halve; the loop ends when no label
    changes. Labels combine on the map side, so a hub sends one row a task.
    Nodes without links are their own component; self-links and duplicates do
    nothing; null ends are dropped.
    """
    real = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    ids = nodes.select("id").where("id is not null").unionByName(both.select(F.col("a").alias("id"))).distinct()
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    labels = cut(ids.join(first, "id", "left").select("id", F.least("id", F.coalesce("least", "id")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        hook = lower.groupBy("old").agg(F.min("component").alias("hooked"))
        least = F.least("component", F.coalesce("further", "component"), F.coalesce("hooked", "component"))
        nxt = cut(lower.join(jump, "component", "left").join(hook, "old").select("id", "old", least.alias("component")))
        changed = nxt.where("component <> old").limit(1).count()
        labels = nxt.select("id", "component")
        if not changed:
            return labels
