"""One object for the operators that a front end calls, with the result budget in tokens."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions import text as tx
from meshline.operators import community, insights, metrics, search, traverse
from meshline.operators.graph import Graph
from meshline.operators.traverse import Options, Result
from meshline.session import cut


@dataclass
class Answer:
    """Seeds, nodes and edges of a bounded query as JSON texts in order, and why it stopped short."""

    seeds: list[str]
    nodes: list[str]
    edges: list[str]
    unresolved: list[str] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)
    estimated_tokens: int = 0


class GraphEngine:
    """Reads of one snapshot. Whole-graph results are cut once and kept for later calls."""

    def __init__(self, graph: Graph, refs: DataFrame | None = None):
        self.graph, self.refs = graph, refs
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    @property
    def degree(self) -> DataFrame:
        return self._once("degree", lambda: metrics.degree(self.graph))

    @property
    def communities(self) -> DataFrame:
        return self._once("communities", lambda: community.partition(self.graph, "leiden"))

    def resolve(self, text: str) -> str:
        """The one node a text names, by the endpoint tiers; none or several are an error."""
        rows = search.endpoint_tiers(self.graph.nodes, [text]).collect()
        if not rows:
            raise LookupError(f"no node matches {text!r}")
        if rows[0]["id"] is None:
            raise LookupError(f"{text!r} is ambiguous at {rows[0]['n']} nodes, use an exact id")
        return rows[0]["id"]

    def query(self, text: str, options: Options | None = None, order: str = "bfs", token_budget: int | None = None, infer_context: bool = False) -> Answer:
        """Seeds by search, then a bounded exploration from them."""
        o = options or Options()
        if infer_context and not o.contexts:
            o = Options(**{**vars(o), "contexts": tuple(tx.infer_contexts(text))})
        seeds = [r["id"] for r in search.seeds(self.graph.nodes, [text]).orderBy("pos").collect()]
        return self._answer(seeds, traverse.explore(self.graph, seeds, o, order, token_budget, self.refs))

    def neighbors(self, text: str, options: Options | None = None, token_budget: int | None = None) -> Answer:
        seed = self.resolve(text)
        return self._answer([seed], traverse.explore(self.graph, [seed], options or Options(), token_budget=token_budget, refs=self.refs))

    def callers(self, text: str) -> Answer:
        return self.neighbors(text, Options(direction="incoming", relations=("calls",)))

    def callees(self, text: str) -> Answer:
        return self.neighbors(text, Options(direction="outgoing", relations=("calls",)))

    def path(self, source: str, target: str, depth: int = 6, direction: str = "outgoing") -> list[str] | None:
        a, b = self.resolve(source), self.resolve(target)
        pair = self.graph.nodes.sparkSession.createDataFrame([(a, b)], "source string, target string")
        return traverse.shortest_paths(self.graph, pair, depth, direction).first()["path"]

    def impact(self, text: str, depth: int = 3, relations: tuple[str, ...] = traverse.IMPACT_RELATIONS) -> DataFrame:
        root = self.graph.nodes.where(F.col("id") == self.resolve(text)).select("id")
        return traverse.impact(self.graph, root, depth, relations)

    def hubs(self, top: int = 10, by: str = "degree") -> DataFrame:
        if by == "pagerank":
            return metrics.hubs(self.graph, top, self._once("pagerank", lambda: metrics.pagerank(self.graph)[0]), "rank")
        return metrics.hubs(self.graph, top, self.degree)

    def surprises(self, keep: int = insights.SURPRISES) -> DataFrame:
        return insights.top_surprises(insights.surprises(insights.eligible_edges(self.graph, self.communities, self.degree)), keep)

    @staticmethod
    def _answer(seeds: list[str], r: Result) -> Answer:
        return Answer([s for s in seeds if s in r.depths], [r.records["node", i] for i in r.nodes], [r.records["edge", i] for i in r.edges], r.unresolved, r.reasons, -(-r.bytes // traverse.BYTES_PER_TOKEN))

    def report(self, top: int = 10) -> str:
        """Markdown on counts, hubs, communities, confidence, cycles and surprises, from collected top lists.

        The graph is read by ten jobs and more, so its rows are kept while they run.
        """
        lazy = self.graph
        self.graph = Graph(lazy.nodes.persist(), lazy.edges.persist())
        try:
            return self._report(top)
        finally:
            self.graph.nodes.unpersist()
            self.graph.edges.unpersist()
            self.graph = lazy

    def _report(self, top: int) -> str:
        g = self.graph
        out = ["# Graph report", "", f"{g.nodes.count()} nodes, {g.edges.count()} edges", "", "## Hubs", ""]
        out += [f"{r['rank']}. {r['id']} ({r['score']})" for r in self.hubs(top).orderBy("rank").collect()]
        labels = community.labels(g, self.communities, self.degree)
        out += ["", "## Communities", ""] + [f"- {r['label']}: {r['size']} nodes" for r in labels.orderBy(F.desc("size"), "community").limit(top).collect()]
        out += ["", "## Confidence", ""] + [f"- {r['confidence']}: {r['n_edges']} ({r['percent']:.1f} %)" for r in metrics.confidence_counts(g).orderBy("confidence").collect()]
        out += ["", "## Import cycles", ""] + [f"- {r['component']}: {r['n_files']} files" for r in metrics.import_cycles(g).select("component", "n_files").distinct().orderBy(F.desc("n_files"), "component").limit(top).collect()]
        out += ["", "## Surprising connections", ""] + [f"- {r['id']} (score {r['score']})" for r in self.surprises().orderBy("rank").collect()]
        return "\n".join(out) + "\n"


def benchmark(call: Callable[[], object], iterations: int = 20) -> dict[str, float]:
    """Median and nearest-rank 95th percentile of the seconds of a call after one warm-up."""
    if not 1 <= iterations <= 1000:
        raise ValueError("1 to 1000 iterations")
    call()
    times = []
    for _ in range(iterations):
        start = time.perf_counter()
        call()
        times.append(time.perf_counter() - start)
    times.sort()
    return {"median": statistics.median(times), "p95": times[-(-95 * iterations // 100) - 1]}
