"""Navigation: adjacency, bounded exploration in exact order, and unbounded walks for many seeds at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.text import context_alias
from meshline.operators.graph import Graph
from meshline.session import cut

WORK_LIMIT = 5_000
MOST_SEEDS = 20
MOST_TOKENS = 1_000_000
BYTES_PER_TOKEN = 4
EMPTY_BYTES = len('{"nodes":[],"edges":[],"unresolved":[]}') + 1
PREFETCH = 16
# A graph up to these sizes is handed to every task as arrays: 8 bytes an arc and the text of the ids.
MOST_NODES, MOST_ARCS = 2_000_000, 16_000_000
BLOCK_CELLS = 1 << 22
BATCH_HITS = 1 << 15
# Relations followed backwards by impact, and those that only widen its seeds.
IMPACT_RELATIONS = ("calls", "indirect_call", "declared_member", "declared_callee", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires", "type", "uses_type", "type_of", "field_type", "parameter_type", "return_type", "generic_arg", "documents")
MEMBERSHIP = ("contains", "method", "defines")


@dataclass
class Options:
    """Bounds and filters of one exploration; values outside their range raise."""

    depth: int = 1
    limit: int = 100
    direction: str = "both"
    relations: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 0 <= self.depth <= 6:
            raise ValueError("depth must be 0 to 6")
        if not 1 <= self.limit <= 500:
            raise ValueError("limit must be 1 to 500")
        if self.direction not in ("incoming", "outgoing", "both"):
            raise ValueError("direction must be incoming, outgoing or both")
        for name in ("relations", "files", "kinds", "contexts"):
            values = getattr(self, name)
            if len(values) > 32 or any(not v or len(v.encode()) > 1024 for v in values):
                raise ValueError(f"{name}: at most 32 values of 1 to 1024 bytes")


@dataclass
class Result:
    """What an exploration admitted, in order, and why it stopped short.

    ``records`` has the JSON text of every admitted node and edge, ``bytes`` the
    size of all that was admitted, with one separator each.
    """

    nodes: list[str] = field(default_factory=list)
    edges: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)
    depths: dict[str, int] = field(default_factory=dict)
    records: dict[tuple[str, str], str] = field(default_factory=dict)
    bytes: int = EMPTY_BYTES
    most_bytes: int | None = None

    def stop(self, reason: str) -> None:
        if reason not in self.reasons:
            self.reasons.append(reason)

    def pay(self, *texts: str) -> bool:
        """Charge records to the budget, all or none."""
        cost = sum(len(t.encode()) + 1 for t in texts)
        if self.most_bytes is not None and self.bytes + cost > self.most_bytes:
            self.stop("token_budget")
            return False
        self.bytes += cost
        return True


def adjacency(g: Graph, direction: str = "both", relations: tuple[str, ...] = ()) -> DataFrame:
    """(id, stream, edge_id, other, relation): what each node sees, undirected edges from both ends.

    Stream 0 is the side the direction names first (outgoing, or incoming for
    "incoming"), stream 1 the other; a self-loop is seen in both. Within a node
    the order is stream, then edge id.
    """
    e = g.edges.where(F.col("relation").isin(*relations)) if relations else g.edges
    out = e if direction != "incoming" else e.where("not directed")
    into = e if direction != "outgoing" else e.where("not directed")
    first, second = (0, 1) if direction != "incoming" else (1, 0)
    a = out.select(F.col("source").alias("id"), F.lit(first).alias("stream"), F.col("id").alias("edge_id"), F.col("target").alias("other"), "relation", "metadata")
    b = into.select(F.col("target").alias("id"), F.lit(second).alias("stream"), F.col("id").alias("edge_id"), F.col("source").alias("other"), "relation", "metadata")
    return a.unionByName(b)


def context_of(metadata: str = "metadata", relation: str = "relation"):
    """Contexts of an edge: its ``context`` attribute, a string or a list of them, or else its relation's alias."""
    raw = F.get_json_object(unwrap(F.col(metadata)), "$.context")
    listed = F.from_json(raw, "array<string>")
    alias = lambda c: context_alias_column(c)
    return F.when(raw.isNull(), F.array(alias(F.col(relation)))).when(raw.startswith("["), F.transform(listed, alias)).otherwise(F.array(alias(raw)))


def unwrap(metadata):
    """Metadata below all layers of provenance that compositions have put around it."""
    layers = F.regexp_count(metadata, F.lit('"original_metadata"'))
    below = F.aggregate(F.sequence(F.lit(1), layers), metadata, lambda m, _: F.coalesce(F.get_json_object(m, "$.original_metadata"), m))
    return F.when(layers > 0, below).otherwise(metadata)


def context_alias_column(c):
    from meshline.functions.text import CONTEXT_ALIASES

    low = F.lower(F.trim(c))
    out = low
    for name, words in CONTEXT_ALIASES.items():
        out = F.when(low.isin(*words), F.lit(name)).otherwise(out)
    return out


def _json(df: DataFrame):
    return F.to_json(F.struct(*df.columns)).alias("json")


class _Reader:
    """Edges of nodes in their order, and the nodes at their other ends that pass the filters, read as they are asked for."""

    def __init__(self, g: Graph, o: Options):
        self.g, self.o = g, o
        self.want = {context_alias(c) for c in o.contexts}
        e = Graph(g.nodes, g.edges.select("*", _json(g.edges), context_of().alias("contexts")))
        adj = adjacency(e, o.direction, o.relations).select("id", "stream", "edge_id", "other")
        self.adjacent = adj
        self.edge_texts = e.edges.select(F.col("id").alias("edge_id"), "json", "contexts")
        self.edges: dict[str, list] = {}
        self.nodes: dict[str, str] = {}
        self.asked: set[str] = set()

    def ask_nodes(self, ids: set[str]) -> None:
        new = ids - self.asked
        self.asked |= new
        if new:
            n = self.g.nodes.where(F.col("id").isin(*new))
            for column, values in (("file", self.o.files), ("kind", self.o.kinds)):
                n = n.where(F.col(column).isin(*values)) if values else n
            self.nodes |= {r["id"]: r["json"] for r in n.select("id", _json(n)).collect()}

    def ask_edges(self, ids: list[str], most: int, level: bool = False) -> None:
        """The first ``most`` edges of the ids, in their order; of several ids that are no level only whole ones are kept."""
        new = [i for i in dict.fromkeys(ids) if i not in self.edges]
        if not new or most <= 0:
            return
        at = self.g.nodes.sparkSession.createDataFrame(list(enumerate(new)), "pos int, id string")
        near = self.adjacent.join(F.broadcast(at), "id").orderBy("pos", "stream", "edge_id").limit(most)
        rows = near.join(self.edge_texts, "edge_id").orderBy("pos", "stream", "edge_id").collect()
        for i in new:
            self.edges[i] = []
        for row in rows:
            self.edges[row["id"]].append(row)
        if len(rows) == most:
            cut_off = new.index(rows[-1]["id"])
            for i in new[cut_off + (level or cut_off == 0) :]:
                del self.edges[i]
        self.ask_nodes({row["other"] for row in rows})

    def fits(self, row) -> bool:
        return not self.want or bool(self.want & set(row["contexts"]))


class _OutOfWork(Exception):
    pass


def explore(g: Graph, seeds: list[str], o: Options, order: str = "bfs", token_budget: int | None = None, refs: DataFrame | None = None) -> Result:
    """Bounded exploration from at most MOST_SEEDS seeds, in the order of a sequential queue (bfs) or stack (dfs).

    Nodes are expanded (their edges examined, WORK_LIMIT in all) and edges
    followed one by one. An edge is admitted when it is followed, together with
    the node it newly reaches; both are charged to the token budget then, and
    what does not fit is neither admitted nor expanded, so no admitted edge has
    an end outside. A breadth-first level is examined before any of its edges is
    followed; where the work limit falls inside a level, that level's edges are
    dropped. Depth-first follows each edge down before the next, and expands a
    node again only when it is reached at a lesser depth. ``refs`` adds the
    unbound references of the admitted nodes, charged last.

    What reaches the driver has the size of the answer: never more than
    WORK_LIMIT edges.
    """
    if token_budget is not None and not 1 <= token_budget <= MOST_TOKENS:
        raise ValueError(f"a token budget must be 1 to {MOST_TOKENS}")
    r = Result(most_bytes=None if token_budget is None else token_budget * BYTES_PER_TOKEN)
    read = _Reader(g, o)
    heads = Options()
    first = _Reader(g, heads)
    first.ask_nodes(set(seeds[:MOST_SEEDS]))
    for s in seeds[:MOST_SEEDS]:
        if len(r.nodes) == o.limit:
            r.stop("node_limit")
            break
        if s in r.depths or s not in first.nodes:
            continue
        if r.pay(first.nodes[s]):
            r.depths[s] = 0
            r.nodes.append(s)
            r.records["node", s] = first.nodes[s]
        elif not r.nodes:
            raise ValueError("the token budget does not hold the first seed")
    if len(seeds) > MOST_SEEDS:
        r.stop("seed_limit")
    examined, expanded = 0, {}

    def expand(node: str, depth: int, beside: list[str] = ()) -> list:
        nonlocal examined
        if depth >= o.depth or expanded.get(node, depth + 1) <= depth:
            return []
        expanded[node] = depth
        if examined == WORK_LIMIT:
            r.stop("work_limit")
            raise _OutOfWork
        if node not in read.edges:
            read.ask_edges([node, *[x for x in beside if x not in read.edges]], WORK_LIMIT)
        rows = read.edges[node][: WORK_LIMIT - examined]
        examined += len(rows)
        if examined == WORK_LIMIT:
            r.stop("work_limit")
        return [x for x in rows if read.fits(x)]

    def follow(row, depth: int) -> bool:
        """Admit an edge and its end; true where the end is to be expanded at ``depth``."""
        other, edge = row["other"], row["edge_id"]
        fresh = other not in r.depths
        if fresh and other not in read.nodes:
            return False
        if fresh and len(r.nodes) == o.limit:
            r.stop("node_limit")
            return False
        new = [] if ("edge", edge) in r.records else [row["json"]]
        if not r.pay(*new, *([read.nodes[other]] if fresh else [])):
            return False
        if fresh:
            r.nodes.append(other)
            r.records["node", other] = read.nodes[other]
        if new:
            r.edges.append(edge)
            r.records["edge", edge] = row["json"]
        if fresh or depth < r.depths[other]:
            r.depths[other] = depth
            return True
        return False

    try:
        if order == "dfs":
            for s in list(r.nodes):
                path = [(iter(expand(s, 0)), 1)]
                while path:
                    rows, depth = path[-1]
                    row = next(rows, None)
                    if row is None:
                        path.pop()
                    elif follow(row, depth):
                        after = [x["other"] for x in read.edges[row["id"]] if x["other"] not in r.depths] if depth < o.depth else []
                        path.append((iter(expand(row["other"], depth, after[:PREFETCH])), depth + 1))
        else:
            level = list(r.nodes)
            for depth in range(o.depth):
                read.ask_edges(level, WORK_LIMIT - examined, level=True)
                rows = [x for node in level for x in expand(node, depth)]
                level = [x["other"] for x in rows if follow(x, depth + 1)]
    except _OutOfWork:
        pass
    if refs is not None and o.direction != "incoming" and r.nodes:
        _add_unresolved(g, refs, o, read.want, r, WORK_LIMIT - examined)
    return r


def _add_unresolved(g: Graph, refs: DataFrame, o: Options, want: set[str], r: Result, work: int) -> None:
    """Unbound references of the admitted nodes, by node and id, as far as work, limit and budget go."""
    at = g.nodes.sparkSession.createDataFrame(list(enumerate(r.nodes)), "pos int, source string")
    mine = refs.where("resolved_target is null").join(F.broadcast(at), "source")
    mine = mine.where(F.col("relation").isin(*o.relations)) if o.relations else mine
    shown = [c for c in ("source", "label", "relation", "file", "line", "reason") if c in refs.columns]
    rows = mine.orderBy("pos", "id").limit(work + 1).select("id", "relation", F.to_json(F.struct(*shown)).alias("json")).collect()
    for k, x in enumerate(rows):
        if k == work:
            r.stop("work_limit")
            break
        if want and context_alias(x["relation"] or "") not in want:
            continue
        if len(r.unresolved) == o.limit:
            r.stop("unresolved_limit")
            break
        if r.pay(x["json"]):
            r.unresolved.append(x["id"])
            r.records["ref", x["id"]] = x["json"]


def induced_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id)."""
    return g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def unresolved_of(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Unbound refs whose source is in ``ids`` (id)."""
    return refs.where("resolved_target is null").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")


def _numbered(g: Graph, relations: tuple[str, ...] = ()) -> Graph:
    """The graph with numbers for ids and only what joins of many seeds need of its edges."""
    e = (g.edges if g.loose is None else g.loose).select("source", "target", "relation", "directed")
    e = g.numbered(e.where(F.col("relation").isin(*relations)) if relations else e)
    return Graph(g.numbers.select(F.col("n").alias("id")), cut(e).withColumns({"id": F.lit(""), "metadata": F.lit("")}))


def _levels(g: Graph, reached: DataFrame, adj: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth): ``reached`` (seed, id) at depth 0 and what lies within ``depth`` steps of it, at its least distance."""
    front = reached
    reached = reached.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        front = cut(front.join(adj, "id").select("seed", F.col("other").alias("id")).distinct().join(reached.select("seed", "id"), ["seed", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front.withColumn("depth", F.lit(k)))
    return reached


def _seeds(g: Graph, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (seed, id) of the numbers of ``seeds`` (id), and of the ids themselves where the graph lacks them."""
    ids = cut(seeds.select("id").distinct())
    pair = lambda x, c: x.select(F.col(c).alias("seed"), F.col(c).alias("id"))
    return cut(pair(ids.join(g.numbers, "id"), "n")), pair(ids.join(g.numbers, "id", "left_anti"), "id")


class _Arcs:
    """Arcs between numbered nodes by their ends, for steps of many seeds at once: a row of bits a node, a bit a seed."""

    def __init__(self, arcs: pa.Table, n: int):
        key = np.unique(arcs["other"].to_numpy().astype(np.int64) * n + arcs["id"].to_numpy())
        self.start, self.end = (key % n).astype(np.int32), (key // n).astype(np.int32)

    def step(self, front: np.ndarray) -> np.ndarray:
        """Rows that are one step away from ``front``."""
        out = np.zeros_like(front)
        use = front.any(axis=1)[self.start]
        start, end = self.start[use], self.end[use]
        if not len(end):
            return out
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        at = np.unique(np.searchsorted(first, np.arange(0, len(end), BLOCK_CELLS // 32)))
        for lo, hi in itertools.pairwise([*at.tolist(), len(first)]):
            a, b = first[lo], first[hi] if hi < len(first) else len(end)
            out[end[first[lo:hi]]] = np.bitwise_or.reduceat(front[start[a:b]], first[lo:hi] - a, axis=0)
        return out


def _found(bits: np.ndarray, depth: int, names: pa.Array, seeds: pa.Array) -> Iterator[pa.RecordBatch]:
    """(seed, id, depth) of the bits that are set, in batches of about BATCH_HITS; the seeds of a node follow each other."""
    rows = np.flatnonzero(bits.any(axis=1))
    hits = np.cumsum(np.bitwise_count(bits[rows]).sum(axis=1, dtype=np.int64))
    at = np.unique(np.searchsorted(hits, np.arange(0, hits[-1] if len(hits) else 0, BATCH_HITS)))
    for lo, hi in itertools.pairwise([*at.tolist(), len(rows)]):
        own = rows[lo:hi]
        row, bit = np.nonzero(np.unpackbits(bits[own].view(np.uint8), axis=1, bitorder="little"))
        yield pa.RecordBatch.from_arrays([seeds.take(pa.array(bit)), names.take(pa.array(own[row])), pa.array(np.full(len(row), depth, np.int32))], ["seed", "id", "depth"])


def _reach(g: Graph, known: DataFrame, adj: DataFrame, depth: int, links: DataFrame | None = None) -> DataFrame:
    """(seed, id, depth) with ids: what ``_levels`` finds from ``known`` (seed, id; the same number) and all below it by ``links``.

    The arcs are handed to every task as arrays, and a task does a block of the
    seeds: a level is one pass over the arcs that joins rows of bits, so pairs
    that are met again cost a bit each, and nothing but the result leaves it.
    """
    spark = adj.sparkSession
    numbers = g.numbers.select("n", "id").toArrow().sort_by("n")
    n = numbers.num_rows
    seeds = np.sort(known.select("seed").toArrow()["seed"].to_numpy()).astype(np.int32)
    ends = lambda x, c: _Arcs(x.select(F.col("id").cast("int"), F.col(c).cast("int").alias("other")).toArrow(), n)
    kept = spark.sparkContext.broadcast((numbers["id"].combine_chunks(), seeds, ends(adj, "other"), links and ends(links, "child")))
    tasks = 4 * spark.sparkContext.defaultParallelism
    block = 64 * max(1, min(8, BLOCK_CELLS // max(n, 1), -(-len(seeds) // (64 * tasks))))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, all_seeds, arcs, below = kept.value
        for k in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            own = all_seeds[k * block : (k + 1) * block]
            called, at = names.take(pa.array(own)), np.arange(len(own))
            reached = np.zeros((len(names), block // 64), np.uint64)
            reached[own, at // 64] |= np.uint64(1) << (at % 64).astype(np.uint64)
            front = reached.copy()
            while below is not None and front.any():
                front = below.step(front) & ~reached
                reached |= front
            front = reached.copy()
            yield from _found(reached, 0, names, called)
            for d in range(1, depth + 1):
                front = arcs.step(front) & ~reached
                if not front.any():
                    break
                reached |= front
                yield from _found(front, d, names, called)

    blocks = -(-len(seeds) // block)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(solve, "seed string, id string, depth int")


def _fits(g: Graph, h: Graph) -> bool:
    return h.edges.count() <= MOST_ARCS // 2 and g.numbers.count() <= MOST_NODES


def walk(g: Graph, seeds: DataFrame, depth: int, direction: str = "outgoing", relations: tuple[str, ...] = ()) -> DataFrame:
    """(seed, id, depth): every node within ``depth`` steps of every seed, at its least distance.

    Breadth-first for all seeds at once, by rows of bits where the graph fits a
    task. Above that a level joins the frontier with the adjacency on the node
    and drops what a seed has already reached. Levels are distinct per (seed,
    node) before they are shuffled, and a hub's adjacency is read by the join in
    parts under adaptive execution. Levels hold numbers for ids, which the
    result gets back at the end.
    """
    known, other = _seeds(g, seeds)
    h = _numbered(g, relations)
    adj = adjacency(h, direction).select("id", "other")
    found = _reach(g, known, adj, depth) if _fits(g, h) else g.named(_levels(g, known, cut(adj.distinct()), depth), "seed", "id")
    return found.unionByName(other.withColumn("depth", F.lit(0)))


def shortest_paths(g: Graph, pairs: DataFrame, depth: int = 6, direction: str = "outgoing", relations: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, length, path, edges): a shortest path for each (source, target), null where none is within ``depth``.

    The search starts from the side with fewer distinct ends, backwards if that
    is the targets. Levels keep, for each node a start reaches, the first parent
    in the order of (parent's path, stream, edge id); the paths are carried
    along, so no walk back is needed. Starts whose ends are all found leave the
    frontier.
    """
    pairs = pairs.where("source is not null and target is not null").distinct()
    few = pairs.agg(F.count_distinct("source").alias("s"), F.count_distinct("target").alias("t")).first()
    back = few["t"] < few["s"]
    if back:
        direction = {"outgoing": "incoming", "incoming": "outgoing"}.get(direction, direction)
    seed, end = ("target", "source") if back else ("source", "target")
    adj = cut(adjacency(g, direction, relations).select("id", "stream", "edge_id", "other"))
    wanted = cut(pairs.select(F.col(seed).alias("seed"), F.col(end).alias("id")))
    reached = cut(wanted.select("seed").distinct().select("seed", F.col("seed").alias("id"), F.lit(0).alias("length"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("edges")))
    front = reached
    for k in range(1, depth + 1):
        open_ = wanted.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").select("seed").distinct()
        grown = front.join(open_, "seed", "left_semi").join(adj, "id").join(reached.select("seed", F.col("id").alias("other")), ["seed", "other"], "left_anti")
        best = grown.groupBy("seed", "other").agg(F.min(F.struct("path", "stream", "edge_id", "edges")).alias("b"))
        front = cut(best.select("seed", F.col("other").alias("id"), F.lit(k).alias("length"), F.concat("b.path", F.array("other")).alias("path"), F.concat("b.edges", F.array("b.edge_id")).alias("edges")))
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front)
    turn = F.reverse if back else (lambda c: c)
    return pairs.join(reached.select(F.col("seed").alias(seed), F.col("id").alias(end), "length", turn(F.col("path")).alias("path"), turn(F.col("edges")).alias("edges")), ["source", "target"], "left")


def _members(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (seed, id) and all below it by ``links`` (id, child)."""
    reached = front = known
    for k in itertools.count(1):
        front = cut(front.join(links, "id").select("seed", F.col("child").alias("id")).distinct().join(reached, ["seed", "id"], "left_anti"))
        if not front.limit(1).count():
            return reached
        reached = reached.unionByName(front)
        reached = reached if k % 8 else cut(reached)  # a long chain has as many rounds


def _membership(h: Graph) -> DataFrame:
    return h.edges.where(F.col("relation").isin(*MEMBERSHIP)).select(F.col("source").alias("id"), F.col("target").alias("child")).distinct()


def impact_seeds(g: Graph, roots: DataFrame) -> DataFrame:
    """(seed, id): each root with everything it contains, defines or has as a method, at any depth."""
    known, other = _seeds(g, roots)
    return g.named(_members(known, cut(_membership(_numbered(g, MEMBERSHIP)))), "seed", "id").unionByName(other)


def impact(g: Graph, roots: DataFrame, depth: int = 3, relations: tuple[str, ...] = IMPACT_RELATIONS) -> DataFrame:
    """(seed, id, depth): what depends on each root or its members, by recorded dependencies followed backwards."""
    if set(relations) & set(MEMBERSHIP):
        raise ValueError("membership relations only widen the seeds of an impact")
    known, other = _seeds(g, roots)
    h = _numbered(g, (*MEMBERSHIP, *relations) if relations else ())
    adj = adjacency(h, "incoming", relations).select("id", "other")
    if _fits(g, h):
        found = _reach(g, known, adj, depth, _membership(h))
    else:
        seeds = _members(known, cut(_membership(h)))
        found = g.named(_levels(g, seeds, cut(adj.distinct()), depth), "seed", "id")
    return found.unionByName(other.withColumn("depth", F.lit(0)))
