"""Communities: Louvain and Leiden kernels, and measures of any given partition."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.operators import metrics as m
from meshline.operators.components import connected_components
from meshline.operators.graph import Graph
from meshline.session import cut, positions

EPSILON = 1e-14


def modularity(sym: DataFrame, part: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition (id, community) over symmetric weights (a, b, weight)."""
    x = sym.join(part.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(part.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    per = x.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    total = per.agg(F.sum("total").alias("w"))
    return per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("inside") / F.col("w") - F.lit(resolution) * F.pow(F.col("total") / F.col("w"), 2)), F.lit(0.0)).alias("modularity"))


def cohesion(sym: DataFrame, part: DataFrame) -> DataFrame:
    """(community, size, pairs, cohesion): distinct neighbour pairs inside over n(n-1); 0 below two members."""
    x = sym.where("weight > 0 and a <> b").join(part.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(part.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    pairs = x.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("pairs"))
    return _cohesion(part, pairs)


def _cohesion(part: DataFrame, pairs: DataFrame) -> DataFrame:
    size = part.groupBy("community").agg(F.count("*").alias("size"))
    out = size.join(pairs, "community", "left").na.fill(0, ["pairs"])
    return out.select("community", "size", "pairs", F.when(F.col("size") < 2, 0.0).otherwise(F.col("pairs") / (F.col("size") * (F.col("size") - 1))).alias("cohesion"))


def connected_split(sym: DataFrame, part: DataFrame) -> DataFrame:
    """(id, community): communities cut into their connected parts over positive weights, named by their smallest id.

    Weights need not be summed, nor be there in both orientations. The rounds
    run over numbers in the order of the ids.
    """
    part = cut(part)
    numbers = cut(part.join(positions(part.select("id").where("id is not null").distinct(), "id", "n"), "id"))
    end = lambda k: numbers.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("community").alias(f"c{k}"))
    inside = sym.where("weight > 0").select("a", "b").join(end("a"), "a").join(end("b"), "b").where("ca = cb")
    parts = connected_components(numbers.select(F.col("n").alias("id")), inside.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    named = parts.join(numbers.select("id", "n").distinct().withColumnRenamed("n", "component").withColumnRenamed("id", "community"), "component")
    return named.select(F.col("id").alias("n"), "community").join(numbers.select("id", "n").distinct(), "n").select("id", "community")


def canonical(part: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by their smallest member id."""
    least = part.groupBy("community").agg(F.min("id").alias("first"))
    return part.join(least, "community").join(positions(least, "first", "n"), "first").select("id", F.col("n").alias("community"))


def labels(g: Graph, part: DataFrame, degree: DataFrame) -> DataFrame:
    """(community, size, label, label_id): the highest-degree member that is no noise names a community."""
    named = part.join(degree.select("id", "degree"), "id").join(g.nodes.where(~m.noise()).select("id", "label"), "id")
    best = named.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("neg"), "id", "label")).alias("b"))
    size = part.groupBy("community").agg(F.count("*").alias("size"))
    return size.join(best, "community", "left").select("community", "size", F.coalesce("b.label", F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("label"), F.col("b.id").alias("label_id"))


def signatures(part: DataFrame) -> DataFrame:
    """(community, signature): digest of the sorted members, equal only for equal membership.

    Members are folded in hashed pieces first, so a giant community is summed
    by pieces of digests, not as one list.
    """
    piece = part.select("community", F.sha2("id", 256).alias("h")).select("community", *[F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"d{k}") for k in range(4)])
    sums = piece.groupBy("community").agg(F.count("*").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(4)])
    return sums.select("community", F.sha2(F.concat_ws(":", "n", *[f"d{k}" for k in range(4)]), 256).alias("signature"))


def hub_threshold(degree: DataFrame, percentile: float) -> int | None:
    """Degree at position n*p/100 (rounded down, less one) of the ascending degrees; hubs are strictly above it."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be 0 to 100")
    hist = degree.groupBy("degree").count().orderBy("degree").collect()  # one row per distinct degree
    n = sum(r["count"] for r in hist)
    at = max(0, int(n * percentile / 100) - 1)
    seen = 0
    for r in hist:
        seen += r["count"]
        if seen > at:
            return r["degree"]
    return None


# --- kernels over one component: adjacency {i: {j: weight}} with self weights counted twice ---


def _local_move(adj: dict, total: float, comm: dict, order: list, gamma: float, sweeps: int) -> bool:
    k = {i: sum(adj[i].values()) for i in adj}
    tot = defaultdict(float)
    for i, c in comm.items():
        tot[c] += k[i]
    taken = set(comm.values())
    free = [c for c in range(len(adj)) if c not in taken]
    moved_any = False
    for _ in range(sweeps):
        moved = False
        for i in order:
            old = comm[i]
            tot[old] -= k[i]
            near = defaultdict(float)
            for j, w in adj[i].items():
                if j != i:
                    near[comm[j]] += w
            near.setdefault(old, 0.0)
            best, best_score = old, near[old] - gamma * k[i] * tot[old] / total
            if tot[old] > 0 and free and -EPSILON > best_score:
                best, best_score = free[-1], 0.0
            for c in sorted(near):
                s = near[c] - gamma * k[i] * tot[c] / total
                if s > best_score + EPSILON:
                    best, best_score = c, s
            tot[best] += k[i]
            if best != old:
                if best in free:
                    free.remove(best)
                comm[i] = best
                moved = moved_any = True
        if not moved:
            break
    return moved_any


def _split(adj: dict, comm: dict) -> dict:
    out, n = {}, 0
    for i in sorted(adj):
        if i in out:
            continue
        todo = [i]
        out[i] = n
        while todo:
            x = todo.pop()
            for y, w in adj[x].items():
                if w > 0 and y not in out and comm[y] == comm[x]:
                    out[y] = n
                    todo.append(y)
        n += 1
    return out


def _aggregate(adj: dict, group: dict) -> dict:
    out: dict = defaultdict(lambda: defaultdict(float))
    for i, row in adj.items():
        out[group[i]]
        for j, w in row.items():
            out[group[i]][group[j]] += w
    return {i: dict(r) for i, r in out.items()}


def kernel(adj: dict, total: float, gamma: float = 1.0, passes: int = 100, algorithm: str = "louvain", seed: int = 42) -> dict:
    """Community of each node of one component by deterministic Louvain, or by Leiden with seeded refinement.

    Nodes move in id order to the community of the highest gain; a move must
    gain more than EPSILON, ties go to the lowest community. Communities are cut
    into connected parts before each level is coarsened.
    """
    if algorithm == "leiden":
        names = sorted(adj)
        at = {i: k for k, i in enumerate(names)}
        arcs = sorted((at[i], at[j], w) for i, row in adj.items() for j, w in row.items())
        a, b, w = (np.array([x[k] for x in arcs], t) for k, t in enumerate((np.int64, np.int64, float)))
        return dict(zip(names, leiden(a, b, w, len(names), total, gamma, passes, seed).tolist(), strict=True))
    where = {i: i for i in adj}
    level = adj
    for _ in range(passes):
        comm = {i: k for k, i in enumerate(sorted(level))}
        _local_move(level, total, comm, sorted(level), gamma, passes)
        group = _split(level, comm)
        where = {i: group[c] for i, c in where.items()}
        if len(set(group.values())) == len(level):
            break
        level = _aggregate(level, group)
    return where


class _Level:
    """One level of Leiden: arcs (a, b, w) sorted by both ends, self weights counted twice."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int):
        self.a, self.b, self.w, self.n = a, b, w, n
        self.strength = np.bincount(a, weights=w, minlength=n).tolist()
        real = a != b
        self.ends, self.weights = b[real].astype(np.int32), w[real]
        self.cuts = np.searchsorted(a[real], np.arange(n + 1)).tolist()

    def near(self, i: int) -> zip:
        """Neighbours and weights of a node, itself left out."""
        lo, hi = self.cuts[i], self.cuts[i + 1]
        return zip(self.ends[lo:hi].tolist(), self.weights[lo:hi].tolist(), strict=True)

    def joined(self, group: np.ndarray, n: int) -> _Level:
        key = group[self.a] * n + group[self.b]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.arange(0)
        w = np.add.reduceat(self.w[order], first) if len(first) else self.w
        return _Level(key[first] // n, key[first] % n, w, n)


def _move_queued(x: _Level, total: float, comm: list, gamma: float, most: int) -> None:
    """Move nodes to the community of the highest gain, in id order, then again those whose neighbours moved away from them."""
    k, tot, size = x.strength, [0.0] * x.n, [0] * x.n
    for i, c in enumerate(comm):
        tot[c] += k[i]
        size[c] += 1
    free = [c for c in range(x.n) if not size[c]]
    queue, queued = deque(range(x.n)), bytearray(b"\1") * x.n
    for _ in range(most * x.n):
        if not queue:
            return
        i = queue.popleft()
        queued[i] = 0
        near: dict = {}
        for j, w in x.near(i):
            c = comm[j]
            near[c] = near.get(c, 0.0) + w
        old, share = comm[i], gamma * k[i] / total
        tot[old] -= k[i]
        best, score = old, near.get(old, 0.0) - share * tot[old]
        if size[old] > 1 and free and score < -EPSILON:
            best, score = free[-1], 0.0
        for c, w in near.items():
            s = w - share * tot[c]
            if s > score + EPSILON or (s >= score - EPSILON and c < best != old):
                best, score = c, max(s, score)
        tot[best] += k[i]
        if best == old:
            continue
        size[old] -= 1
        size[best] += 1
        if free and best == free[-1]:
            free.pop()
        if not size[old]:
            tot[old] = 0.0
            free.append(old)
        comm[i] = best
        for j, _w in x.near(i):
            if not queued[j] and comm[j] != best:
                queued[j] = 1
                queue.append(j)


def _refined(x: _Level, total: float, comm: list, gamma: float, rng: random.Random) -> list:
    """Communities inside ``comm``: nodes that are still alone join, in random order, what gains most."""
    k, fine, inside, alone = x.strength, list(range(x.n)), list(x.strength), bytearray(b"\1") * x.n
    order = list(range(x.n))
    rng.shuffle(order)
    for i in order:
        if not alone[i]:
            continue
        near: dict = {}
        mine = comm[i]
        for j, w in x.near(i):
            if comm[j] == mine:
                near[fine[j]] = near.get(fine[j], 0.0) + w
        share = gamma * k[i] / total
        gains = [(w - share * inside[c], c) for c, w in sorted(near.items())]
        top = max((s for s, _ in gains), default=0.0)
        if top > EPSILON:
            c = rng.choice([c for s, c in gains if s >= top - EPSILON])
            inside[i] -= k[i]
            inside[c] += k[i]
            fine[i] = c
            alone[i] = alone[c] = 0
    return fine


def _ranked(labels: list) -> tuple[np.ndarray, int]:
    """Labels as numbers from 0 in the order of their first members, and how many there are."""
    rank: dict = {}
    return np.array([rank.setdefault(c, len(rank)) for c in labels], np.int64), len(rank)


def leiden(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, total: float, gamma: float = 1.0, passes: int = 100, seed: int = 42) -> np.ndarray:
    """Community of each of ``n`` nodes by Leiden, over arcs sorted by both ends.

    A level starts from the communities of the level before and visits again
    only nodes whose neighbours moved; what it coarsens are the connected
    communities of the refinement.
    """
    where, level, comm, rng = np.arange(n), _Level(a, b, w, n), list(range(n)), random.Random(seed)
    for _ in range(passes):
        _move_queued(level, total, comm, gamma, passes)
        if len(set(comm)) == level.n:
            break
        group, m = _ranked(_refined(level, total, comm, gamma, rng))
        stuck = m == level.n
        if stuck:
            group, m = _ranked(_connected(level, comm))
        where = group[where]
        if stuck:
            break
        wide = np.empty(m, np.int64)
        wide[group] = _ranked(comm)[0]
        level, comm = level.joined(group, m), wide.tolist()
    return where


def _connected(x: _Level, comm: list) -> list:
    """The connected parts of communities, named by their smallest nodes."""
    part = [-1] * x.n
    for i in range(x.n):
        todo = [i] if part[i] < 0 else []
        while todo:
            y = todo.pop()
            part[y] = i
            todo += [j for j, w in x.near(y) if w > 0 and part[j] < 0 and comm[j] == comm[i]]
    return part


def partition(g: Graph, algorithm: str = "louvain", resolution: float = 1.0, passes: int = 100, seed: int = 42) -> DataFrame:
    """(id, community): connected communities, named by their smallest member.

    Components do not interact but for the total weight, so each one is solved
    by the kernel in one group, whatever its size: algorithm, passes and seed
    hold for all. A component's arcs must fit the memory of one task.
    """
    if algorithm not in ("louvain", "leiden") or resolution <= 0 or passes < 1:
        raise ValueError("algorithm must be louvain or leiden, resolution and passes above 0")
    ids = g.numbers.select(F.col("n").alias("id"))
    return g.named(_solved(ids, cut(m.halves(g).where("weight > 0")), algorithm, resolution, passes, seed), "community", "id")


def _solved(ids: DataFrame, half: DataFrame, algorithm: str, resolution: float, passes: int, seed: int) -> DataFrame:
    """The partition of numbered nodes (id) by positive weights (a, b, weight) of a <= b, a self-loop counted once."""
    total = (half.agg(F.sum("weight")).first()[0] or 0.0) * 2
    if not total:
        return ids.select("id", F.col("id").alias("community"))
    parts = connected_components(ids, half.select("a", "b"))
    arcs = half.join(parts.select(F.col("id").alias("a"), "component"), "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate((pdf["a"], pdf["b"])), return_inverse=True)
        x, y = ends[: len(pdf)], ends[len(pdf) :]
        two = x != y
        a, b = np.concatenate((x, y[two])), np.concatenate((y, x[two]))
        w = np.concatenate((np.where(two, pdf["weight"], 2 * pdf["weight"]), pdf["weight"].to_numpy()[two]))
        order = np.lexsort((b, a))  # sums over neighbours come out the same on every run
        if algorithm == "leiden":
            got = leiden(a[order], b[order], w[order], len(names), total, resolution, passes, seed)
            return pd.DataFrame({"id": names, "community": names[np.unique(got, return_index=True)[1]][np.unique(got, return_inverse=True)[1]]})
        keys, cuts = list(range(len(names))), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
        b, w = b[order].tolist(), w[order].tolist()
        adj: dict = {k: {keys[j]: v for j, v in zip(b[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]], strict=True)} for k in keys}
        del a, b, w, order, ends, x, y, two
        got = kernel(adj, total, resolution, passes, algorithm, seed)
        first: dict = {}
        for k, c in sorted(got.items()):
            first.setdefault(c, names[k])
        return pd.DataFrame({"id": names, "community": [first[got[k]] for k in keys]})

    linked = cut(arcs.groupBy("component").applyInPandas(lambda pdf: solve(pdf), "id long, community long"))
    return linked.unionByName(ids.join(linked, "id", "left_anti").select("id", F.col("id").alias("community")))


def exclude_hubs(g: Graph, sym: DataFrame, percentile: float, algorithm: str = "louvain") -> DataFrame:
    """(id, community): communities found without the hubs, which then join the majority of their assigned neighbours.

    Hubs are placed in the order of their ids, since each may be a neighbour of
    the next: a round places all hubs whose neighbouring hubs of lower id are
    placed, so the rounds are as many as the longest such chain, and nothing is
    collected. Ties go to the smallest community, a hub without assigned
    neighbours is its own.
    """
    deg = cut(m.degree(g))
    above = hub_threshold(deg, percentile)
    if above is None:
        return g.ids.select("id", F.col("id").alias("community"))
    hubs = cut(deg.where(F.col("degree") > above).select("id"))
    rest = Graph(g.nodes.join(hubs, "id", "left_anti"), g.edges.join(hubs.withColumnRenamed("id", "source"), "source", "left_anti").join(hubs.withColumnRenamed("id", "target"), "target", "left_anti").select(*g.edges.columns))
    part = cut(partition(rest, algorithm))
    near = cut(sym.where("weight > 0 and a <> b").join(hubs.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b").distinct())
    votes = cut(near.join(part.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n")))
    among = cut(near.join(hubs.withColumnRenamed("id", "b"), "b", "left_semi"))
    placed, waiting = None, hubs
    while waiting.limit(1).count():
        blocked = among.where("b < a").join(waiting.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        ready = waiting.join(blocked, "id", "left_anti")
        told = votes.join(ready.select(F.col("id").alias("a")), "a", "left_semi")
        if placed is not None:
            lower = among.where("b < a").join(placed.withColumnRenamed("id", "b"), "b").join(ready.select(F.col("id").alias("a")), "a", "left_semi")
            told = told.unionByName(lower.groupBy("a", "community").agg(F.count("*").alias("n"))).groupBy("a", "community").agg(F.sum("n").alias("n"))
        top = told.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("neg"), "community")).alias("b"))
        now = ready.join(top, "id", "left").select("id", F.coalesce("b.community", "id").alias("community"))
        placed = cut(now if placed is None else placed.unionByName(now))
        waiting = cut(waiting.join(placed, "id", "left_anti"))
    return part if placed is None else part.unionByName(placed)


def split_again(g: Graph, part: DataFrame, most_size: int | None = None, least_cohesion: float | None = None, resolution: float = 1.0) -> DataFrame:
    """(id, community): communities above a size or below a cohesion are partitioned once more on their own.

    The inner partition uses a resolution of at least 1 and is kept where it
    has more than one part; others stay whole.
    """
    part = cut(part.select("id", "community"))
    known = cut(part.join(g.numbers, "id").select("n", "community"))
    end = lambda k: known.select(F.col("n").alias(k), F.col("community").alias(f"c{k}"))
    inside = cut(m.halves(g).where("weight > 0").join(end("a"), "a").join(end("b"), "b").where("ca = cb").select(F.col("ca").alias("community"), "a", "b", "weight"))
    pairs = inside.where("a <> b").groupBy("community").agg((2 * F.count("*")).alias("pairs"))
    told = _cohesion(part, pairs)
    bad = F.lit(False)
    if most_size is not None:
        bad = bad | (F.col("size") > most_size)
    if least_cohesion is not None:
        bad = bad | ((F.col("cohesion") < least_cohesion) & (F.col("size") > 1))
    again = cut(told.where(bad).select("community"))
    members = cut(known.join(again, "community", "left_semi").select(F.col("n").alias("id")))
    finer = _solved(members, cut(inside.join(again, "community", "left_semi").select("a", "b", "weight")), "louvain", max(resolution, 1.0), 100, 42)
    return part.join(again, "community", "left_anti").select("id", "community").unionByName(g.named(finer, "community", "id"))


def preserved(nodes: DataFrame) -> DataFrame:
    """(project, community_type, community, size): memberships that came with the nodes; 7 and "7" are different ones."""
    meta = F.try_parse_json("metadata")
    value = F.try_variant_get(F.coalesce(F.try_variant_get(meta, "$.original_metadata", "variant"), meta), "$.community", "variant")
    kind = F.when(F.schema_of_variant(value) == "STRING", "string").when(F.schema_of_variant(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
    x = nodes.select(F.get_json_object("metadata", "$.project").alias("project"), kind.alias("community_type"), value.cast("string").alias("community")).where("community is not null and community_type is not null")
    return x.groupBy("project", "community_type", "community").agg(F.count("*").alias("size"))
