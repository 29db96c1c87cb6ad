"""Metrics, binding, navigation, search, communities, sources and streaming on small graphs."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from meshline.functions import text as tx
from meshline.operators import community, compose, feedback, insights, lookup, memory, metrics, resolve, search, traverse
from meshline.operators.graph import Graph
from meshline.plans import exchange
from meshline.sources import export, extract, node_link, scan
from meshline.streaming.refresh import Generations, refresh, stream_table

NODES = "id string, label string, kind string, file string, line int, end_line int, qualified_name string, binding_key string, metadata string, repo string"
EDGES = "id string, source string, target string, relation string, directed boolean, file string, line int, confidence string, metadata string, ref_id string"


def graph(spark, n, edges, labels=None):
    nodes = [(f"n{i:02d}", (labels or {}).get(i, f"label{i}"), "function", f"file{i}.py", 1, 2, None, None, "{}", None) for i in range(n)]
    rows = [(f"e{k:03d}", f"n{a:02d}", f"n{b:02d}", rel, d, None, None, "EXTRACTED", json.dumps({"weight": w}), None) for k, (a, b, w, d, rel) in enumerate(edges)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES))


def call(a, b, w=1.0, d=True):
    return (a, b, w, d, "calls")


def test_pagerank_of_two(spark):
    ranks, rounds, converged = metrics.pagerank(graph(spark, 2, [call(0, 1)]))
    got = {r["id"]: r["rank"] for r in ranks.collect()}
    assert converged and rounds < 200
    assert got["n00"] == pytest.approx(20 / 57, abs=1e-9) and got["n01"] == pytest.approx(37 / 57, abs=1e-9)


def test_degrees_of_mixed_multigraph(spark):
    g = graph(spark, 3, [call(0, 1, 1), call(0, 1, 2, False), call(0, 0, 3, False), call(1, 1, 4)])
    got = {r["id"]: tuple(r)[1:] for r in metrics.degree(g).collect()}
    assert got == {"n00": (4, 3, 4, 9.0), "n01": (4, 3, 2, 11.0), "n02": (0, 0, 0, 0.0)}
    assert [r["id"] for r in metrics.hubs(g).orderBy("rank").collect()] == ["n00", "n01", "n02"]


def test_bad_weight_fails(spark):
    with pytest.raises(Exception, match="finite"):
        graph(spark, 2, [call(0, 1, -1)]).weighted.collect()


def cliques(spark):
    edges = [call(a, b, 1, False) for base in (0, 5) for a in range(base, base + 5) for b in range(base, a)]
    return graph(spark, 11, [*edges, call(4, 5, 1, False)])


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_two_cliques(spark, algorithm):
    g = cliques(spark)
    part = community.cut(community.partition(g, algorithm))
    sizes = sorted(r["count"] for r in part.groupBy("community").count().collect())
    assert sizes == [1, 5, 5]
    assert community.modularity(metrics.symmetric(g), part).first()[0] == pytest.approx(19 / 42, abs=1e-10)


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_kernel_solves_components_of_any_size(spark, monkeypatch, algorithm):
    monkeypatch.setattr(community, "KERNEL_ARCS", 10, raising=False)
    rng = random.Random(4)
    g = graph(spark, 40, [call(a, rng.randrange(a), 1, False) for a in range(1, 40) for _ in range(2)])
    rows = metrics.symmetric(g).collect()
    adj = {k: {} for k in range(40)}
    for r in sorted(rows):
        adj[int(r["a"][1:])][int(r["b"][1:])] = r["weight"]
    total = sum(r["weight"] for r in rows)
    for passes in (1, 100):
        want, got = community.kernel(adj, total, 1.0, passes, algorithm, 7), {}
        for r in community.partition(g, algorithm, passes=passes, seed=7).collect():
            got[int(r["id"][1:])] = int(r["community"][1:])
        assert got == {i: min(j for j in want if want[j] == c) for i, c in want.items()}


def test_strongly_connected(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(32)]
    reach = {a: {a} for a in range(25)}
    for _ in range(25):
        for a in reach:
            reach[a] |= {y for x, y in pairs if x in reach[a]}
    want = {}
    for a in range(25):
        same = {b for b in range(25) if b in reach[a] and a in reach[b]}
        if len(same) > 1 or (a, a) in pairs:
            want[f"{a:02d}"] = f"{min(same):02d}"
    links = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "src string, dst string")
    assert {r["id"]: r["component"] for r in metrics.strongly_connected(links).collect()} == want


def test_binding_order_and_ambiguity(spark):
    keys = spark.createDataFrame([("one", "a"), ("two", "b"), ("two", "c")], "key string, node_id string")
    refs = spark.createDataFrame([("r1", ["none", "one", "two"], ""), ("r2", ["two", "one"], "x"), ("r3", ["none"], "mine"), ("r4", None, None), ("r5", [None, "one"], "")], "id string, candidate_keys array<string>, reason string")
    got = {r["ref_id"]: (r["target"], r["reason"]) for r in resolve.bind(refs, keys).collect()}
    assert got == {"r1": ("a", ""), "r2": (None, "ambiguous binding: two"), "r3": (None, "mine"), "r4": (None, "no matching binding"), "r5": ("a", "")}


def sequential_bfs(edges, seeds, depth, limit):
    """Queue model of bounded exploration in both directions."""
    order, edge_order, at, queue = list(seeds), [], {s: 0 for s in seeds}, deque(seeds)
    while queue:
        x = queue.popleft()
        if at[x] >= depth:
            continue
        seen = [(0, e, b) for e, a, b in edges if a == x] + [(1, e, a) for e, a, b in edges if b == x]
        for _, e, other in sorted(seen):
            if other not in at:
                if len(order) >= limit:
                    continue
                at[other] = at[x] + 1
                order.append(other)
                queue.append(other)
            if e not in edge_order:
                edge_order.append(e)
    return order, edge_order


def test_explore_agrees_with_a_queue(spark):
    rng = random.Random(7)
    edges = [call(rng.randrange(14), rng.randrange(14)) for _ in range(24)]
    g = graph(spark, 14, edges)
    flat = [(f"e{k:03d}", f"n{a:02d}", f"n{b:02d}") for k, (a, b, *_) in enumerate(edges)]
    for limit in (5, 100):
        found = traverse.explore(g, ["n00", "n01"], traverse.Options(depth=2, limit=limit))
        assert (found.nodes, found.edges) == sequential_bfs(flat, ["n00", "n01"], 2, limit)


def test_depth_first_goes_down_before_it_goes_on(spark):
    """a-b, a-c, b-d, c-e: three nodes are a, b, c in breadth and a, b, d in depth."""
    g = graph(spark, 5, [call(0, 1), call(0, 2), call(1, 3), call(2, 4)])
    o = traverse.Options(depth=3, direction="outgoing", limit=3)
    bfs, dfs = traverse.explore(g, ["n00"], o), traverse.explore(g, ["n00"], o, "dfs")
    assert bfs.nodes == ["n00", "n01", "n02"] and dfs.nodes == ["n00", "n01", "n03"]
    assert "node_limit" in bfs.reasons and "node_limit" in dfs.reasons
    assert bfs.edges == ["e000", "e001"] and dfs.edges == ["e000", "e002"]
    dfs = traverse.explore(g, ["n00"], traverse.Options(depth=3, direction="outgoing"), "dfs")
    assert dfs.nodes == ["n00", "n01", "n03", "n02", "n04"]
    with pytest.raises(ValueError):
        traverse.Options(depth=7)
    with pytest.raises(ValueError):
        traverse.impact(g, g.ids, relations=("contains",))


def sequential_dfs(edges, seeds, depth, limit):
    order, edge_order, at, opened = list(seeds), [], {s: 0 for s in seeds}, {}

    def go(x, d):
        if d >= depth or opened.get(x, d + 1) <= d:
            return
        opened[x] = d
        for _, e, other in sorted([(0, e, b) for e, a, b in edges if a == x] + [(1, e, a) for e, a, b in edges if b == x]):
            fresh = other not in at
            if fresh:
                if len(order) == limit:
                    continue
                order.append(other)
            if e not in edge_order:
                edge_order.append(e)
            if fresh or d + 1 < at[other]:
                at[other] = d + 1
                go(other, d + 1)

    for s in seeds:
        go(s, 0)
    return order, edge_order, at


def test_explore_agrees_with_a_stack(spark, monkeypatch):
    rng = random.Random(11)
    edges = [call(rng.randrange(12), rng.randrange(12)) for _ in range(22)]
    g = graph(spark, 12, edges)
    flat = [(f"e{k:03d}", f"n{a:02d}", f"n{b:02d}") for k, (a, b, *_) in enumerate(edges)]
    for limit, prefetch in ((6, 16), (100, 2)):
        monkeypatch.setattr(traverse, "PREFETCH", prefetch)
        found = traverse.explore(g, ["n00", "n01"], traverse.Options(depth=3, limit=limit), "dfs")
        assert (found.nodes, found.edges, found.depths) == sequential_dfs(flat, ["n00", "n01"], 3, limit)


def test_budget_charges_an_edge_with_its_end(spark):
    """b is too large: neither it, its edges, nor what only it leads to is admitted."""
    g = graph(spark, 5, [call(0, 1), call(0, 2), call(1, 3), call(2, 4)], {1: "x" * 2_000})
    for order in ("bfs", "dfs"):
        full = traverse.explore(g, ["n00"], traverse.Options(depth=3, direction="outgoing"), order)
        found = traverse.explore(g, ["n00"], traverse.Options(depth=3, direction="outgoing"), order, token_budget=450)
        assert found.nodes == ["n00", "n02", "n04"] and found.edges == ["e001", "e003"] and found.reasons == ["token_budget"]
        assert found.bytes <= 1800 < full.bytes and found.bytes == traverse.EMPTY_BYTES + sum(len(x) + 1 for x in found.records.values())
    with pytest.raises(ValueError):
        traverse.explore(g, ["n01"], traverse.Options(), token_budget=100)


def test_work_limit_and_unresolved(spark, monkeypatch):
    monkeypatch.setattr(traverse, "WORK_LIMIT", 4)
    g = graph(spark, 7, [call(0, 1), call(0, 2), call(0, 3), call(1, 4), call(1, 5), call(2, 6)])
    found = traverse.explore(g, ["n00"], traverse.Options(depth=2, direction="outgoing"))
    assert found.nodes == ["n00", "n01", "n02", "n03"] and found.reasons == ["work_limit"]  # the second level is cut, so dropped
    dfs = traverse.explore(g, ["n00"], traverse.Options(depth=2, direction="outgoing"), "dfs")
    assert dfs.nodes == ["n00", "n01", "n04", "n02"] and dfs.reasons == ["work_limit"]  # n02 is reached, not expanded
    monkeypatch.setattr(traverse, "WORK_LIMIT", 100)
    refs = spark.createDataFrame([("r1", "n01", None, "calls", "one"), ("r2", "n00", None, "calls", "two"), ("r3", "n00", "n05", "calls", "bound"), ("r4", "n06", None, "calls", "far"), ("r5", "n00", None, "uses", "three")], "id string, source string, resolved_target string, relation string, label string")
    found = traverse.explore(g, ["n00"], traverse.Options(depth=1, direction="outgoing"), refs=refs)
    assert found.unresolved == ["r2", "r5", "r1"]
    assert traverse.explore(g, ["n00"], traverse.Options(depth=1, direction="incoming"), refs=refs).unresolved == []


def test_contexts_below_layers_of_provenance(spark):
    text = '{"project": "one", "original_metadata": {"original_metadata": {"context": "call"}}}'
    e = spark.createDataFrame([("e1", text, "custom"), ("e2", '{"context": ["import", "call"]}', "x"), ("e3", None, "imports")], "id string, metadata string, relation string")
    got = {r["id"]: r["c"] for r in e.select("id", traverse.context_of().alias("c")).collect()}
    call_, import_ = got["e1"][0], got["e3"][0]
    assert got["e2"] == [import_, call_] and call_ != import_ and len(got["e1"]) == 1


def test_package_links_join_all_pairs_of_different_projects(spark):
    rows = [("1", "package", "package:npm:x", "A"), ("2", "package", "package:npm:x", "A"), ("3", "package", "package:npm:x", "B"), ("4", "package", "package:npm:x", "C"), ("4", "package", "package:npm:x", "C")]
    rows += [("5", "package", "package:npm:lone", "A"), ("6", "package", "package:npm:lone", "A"), ("7", "package", "npm:x", "D"), ("8", "package", "package::x", "D"), ("9", "module", "package:npm:x", "D"), ("10", "package", "package:npm:x", None), ("11", "package", "package:a:b c", "A"), ("12", "package", "package:a:b c", "B")]
    nodes = spark.createDataFrame(rows, "id string, kind string, binding_key string, project string")
    assert {(r["a"], r["b"]) for r in compose.link_packages(nodes).collect()} == {("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")}
    assert {r["id"]: r["n_links"] for r in compose.package_classes(nodes).collect()} == {"1": 2, "2": 2, "3": 3, "4": 3}


def test_shortest_path(spark):
    g = graph(spark, 5, [call(0, 1), call(1, 2), call(0, 3), call(3, 2), call(2, 4)])
    pairs = spark.createDataFrame([("n00", "n04"), ("n04", "n00"), ("n00", "n00")], "source string, target string")
    got = {(r["source"], r["target"]): (r["length"], r["path"]) for r in traverse.shortest_paths(g, pairs).collect()}
    assert got == {("n00", "n04"): (3, ["n00", "n01", "n02", "n04"]), ("n04", "n00"): (None, None), ("n00", "n00"): (0, ["n00"])}


def test_search_terms_and_seeds(spark):
    assert tx.search_terms("which functions call the route?") == ["functions", "route"]
    assert tx.search_terms("calls") == ["calls"]
    with pytest.raises(ValueError):
        tx.search_terms(" ".join(f"w{i}" for i in range(9)))
    assert tx.normalize("Éﬁ") == "efi" and tx.search_terms("图数据库") == ["图数", "据库", "数据"]
    g = graph(spark, 4, [], {0: "parseRoute", 1: "route", 2: "routeTable", 3: "other"})
    rows = search.seeds(g.nodes, ["parse route tables"]).orderBy("pos").collect()
    assert rows[0]["id"] == "n01" and {r["id"] for r in rows} <= {"n00", "n01", "n02"}
    assert [r["id"] for r in search.seeds(g.nodes, ["route"]).collect()] == ["n01"]  # an exact label decides alone


def test_node_link_reader_is_strict():
    ok = {"directed": True, "multigraph": False, "nodes": [{"id": 1}, {"id": "b", "source_location": "L2-L5"}], "links": [{"source": 1, "target": "b"}], "groups": [{"nodes": ["b"]}]}
    nodes, edges = node_link.parse_node_link(json.dumps(ok))
    assert [n[0] for n in nodes] == ["integer:1", "b", "group:0"] and nodes[1][4:6] == (2, 5) and edges[1][3] == "member_of"
    for bad in (
        {**ok, "nodes": [{"id": 1.5}]}, {**ok, "links": [{"source": 1, "target": "zzz"}]}, {**ok, "links": ok["links"] * 2}, {**ok, "edges": []},
        {**ok, "links": [{"source": 1, "target": "b", "_src": 1}]}, {**ok, "nodes": [{"id": 1, "source_location": "L5-L2"}]}, {**ok, "directed": 1}, {**ok, "groups": [{"nodes": []}]},
    ):
        with pytest.raises(ValueError):
            node_link.parse_node_link(json.dumps(bad))
    with pytest.raises(ValueError, match="duplicate"):
        node_link.strict_json('{"a": 1, "a": 2}')


def test_extraction():
    md = extract.markdown("---\ntitle: x\n---\n# A\nsee [b](../c.md) and [[W|w]] `f()` because https://x.y/z.\n```\n# no\n```\n## B ##")
    assert ("heading", "A", None, 1, 4) in md and ("heading", "B", None, 2, 9) in md and ("link", "b", "../c.md", None, 5) in md and ("wikilink", "w", "W", None, 5) in md
    assert any(f[0] == "rationale" for f in md) and ("url", "https://x.y/z", "https://x.y/z", None, 5) in md and not any(f[1] == "no" for f in md)
    assert extract.plain("Title\n=====\ntext\nSub\n---\n")[:1] == [("heading", "Title", None, 1, 1)]
    assert extract.html("<title>T</title><script>a</script><h2>H <b>x</b></h2><a href='/p'>l</a>") == [("title", "T", None, None, None), ("heading", "H x", None, 2, None), ("link", "l", "/p", None, None)]
    got = extract.sql("create view v as with c as (select * from t1) select * from c join t2 on 1=1; -- from zzz\nalter table q add x int;")
    assert ("reads_from", "v", "t1", None, 1) in got and ("reads_from", "v", "t2", None, 1) in got and not any(f[2] == "c" for f in got) and ("alters", "q", None, None, 2) in got
    assert ("class", "A", None, 0, 1) in extract.python("class A(B):\n  def f(self):\n    return g()\n")
    assert extract.facts_of("x.py", "def (") == [("diagnostic", "SyntaxError", None, None, None)]
    assert tx.relative_path("a/b/c.md", "../d.md") == "a/d.md" and tx.relative_path("a.md", "../../x") is None
    assert scan.ignored("a/build/x.py", ["build/", "!x"]) and not scan.ignored("a/x.py", ["*.py", "!x.py"])


def test_generations_and_stream(spark, tmp_path):
    rows = [("a", 1, "old"), ("b", 1, "keep")]
    src = tmp_path / "d"
    spark.createDataFrame(rows, "id string, generation bigint, v string").coalesce(1).write.parquet(str(src / "t.parquet"))
    spark.createDataFrame([("a", 2, "new")], "id string, generation bigint, v string").coalesce(1).write.mode("append").parquet(str(src / "t.parquet"))
    target = Generations(spark, str(tmp_path / "g"))
    refresh(stream_table(spark, str(src), "t"), target, "id", ["generation", "v"])
    assert {(r["id"], r["v"]) for r in target.read().collect()} == {("a", "new"), ("b", "keep")}
    now = target.state()["generation"]
    with pytest.raises(RuntimeError, match="stale"):
        target.publish(target.read(), now - 1)
    assert target.publish(target.read(), now, batch=0) == now  # a replayed batch changes nothing
    assert {(r["id"], r["v"]) for r in target.read(1).collect()} <= {("a", "old"), ("a", "new"), ("b", "keep")}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """The second writer passed the check of the baseline before the first one's pointer was there."""
    one = Generations(spark, str(tmp_path / "g"))
    two = Generations(spark, str(tmp_path / "g"))
    before = two.state()
    assert one.read() is None and one.publish(spark.range(3).toDF("id"), 0) == 1
    real = Generations.state
    monkeypatch.setattr(two, "state", lambda: before)
    with pytest.raises(RuntimeError, match="stale"):
        two.publish(spark.range(9).toDF("id"), 0)
    monkeypatch.setattr(two, "state", lambda: real(two))
    assert two.read().count() == 3 and len([x for x in (tmp_path / "g").iterdir() if x.name.startswith("gen=")]) == 1


def test_guarded_write_keeps_both_tables_together(spark, tmp_path):
    g = graph(spark, 3, [call(0, 1), call(1, 2)])
    assert export.guarded_write(g, str(tmp_path / "x")) == {"nodes": 3, "edges": 2}
    small = graph(spark, 2, [call(0, 1)])
    with pytest.raises(ValueError, match="shrink"):
        export.guarded_write(small, str(tmp_path / "x"))
    got = export.read_written(spark, str(tmp_path / "x"))
    assert got.nodes.columns == g.nodes.columns and got.edges.columns == g.edges.columns and sorted(got.edges.collect()) == sorted(g.edges.collect())
    export.guarded_write(small, str(tmp_path / "x"), allow_shrink=True)
    assert export.read_written(spark, str(tmp_path / "x")).nodes.count() == 2 and export.read_written(spark, str(tmp_path / "x"), 1).nodes.count() == 3
    with pytest.raises(FileNotFoundError):
        export.read_written(spark, str(tmp_path / "none"))


def test_escapes(spark):
    text = 'a<b & "c" é🚀'
    g = graph(spark, 1, [], {0: text})
    assert tx.xml_escape(text) in export.graphml_rows(g).first()["xml"] and tx.mermaid_escape(text) in export.mermaid_rows(g).first()["line"]
    with pytest.raises(Exception, match="control character"):
        export.graphml_rows(graph(spark, 1, [], {0: "a\x01"})).collect()


def test_positions(spark):
    from meshline.session import positions

    ids = [f"k{random.Random(i).randrange(10**9)}" for i in range(300)]
    got = {r["id"]: r["k"] for r in positions(spark.createDataFrame([(i,) for i in ids], "id string").repartition(5), "id", "k").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}
    assert positions(spark.createDataFrame([], "id string"), "id", "k").count() == 0


def test_hubs_are_placed_in_the_order_of_ids(spark):
    """h0 follows its own neighbours; h1 has one plain neighbour and two placed hubs, so it follows them."""
    edges = [call(a, b) for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]]
    g = graph(spark, 9, edges + [call(6, x) for x in (0, 1, 2, 7)] + [call(7, x) for x in (3, 8, 6)] + [call(8, x) for x in (0, 1, 7, 2)])
    part = {r["id"]: r["community"] for r in community.exclude_hubs(g, community.cut(metrics.symmetric(g)), 66.0).collect()}
    assert part["n06"] == part["n08"] == "n00" and len(part) == 9


def test_compose_and_feedback(spark):
    g = graph(spark, 2, [call(0, 1)])
    both = compose.merge({"p": g, "q": g})
    assert both.nodes.select("id").distinct().count() == 4 and both.nodes.where("id = 'project:[\"p\",\"n00\"]'").count() == 1
    assert compose.fingerprint(g.edges, ["id"]).first() == compose.fingerprint(g.edges.repartition(3), ["id"]).first()
    ev = spark.createDataFrame([("e1", 0, "useful", ["a", "a"]), ("e2", 30 * 86400, "dead_end", ["a"]), ("e3", 10**9, "useful", ["a"]), ("e4", 0, None, ["b"])], "event_id string, at bigint, outcome string, nodes array<string>")
    got = {r["node_id"]: tuple(r)[1:] for r in feedback.decayed_scores(ev, 30 * 86400).collect()}
    assert got == {"a": (-0.5, 1, 1, 1), "b": (0.0, 0, 0, 0)}
    paths = spark.createDataFrame([("x/a.py",), ("a.py",), ("zz.py",)], "path string")
    files = spark.createDataFrame([("r/x/a.py",), ("a.py",), ("s/x/a.py",)], "file string")
    assert {(r["path"], r["file"], r["n"]) for r in feedback.file_matches(paths, files).collect()} == {("x/a.py", None, 2), ("a.py", "a.py", 1), ("zz.py", None, 0)}


def test_surprise_scores(spark):
    g = graph(spark, 3, [call(0, 1), call(1, 2), (0, 2, 1.0, True, "imports")])
    part = g.nodes.select("id", F.lit("c").alias("community"))
    rows = insights.surprises(insights.eligible_edges(g, part, metrics.degree(g))).collect()
    assert {r["id"]: r["score"] for r in rows} == {"e000": 2, "e001": 2}


def test_order_of_rows_does_not_matter(spark):
    g = graph(spark, 6, [call(0, 1), call(1, 2), call(2, 0), call(3, 4, 2, False)])
    h = Graph(g.nodes.orderBy(F.desc("id")), g.edges.repartition(3).orderBy(F.desc("id")))
    for f in (metrics.degree, metrics.arcs, metrics.symmetric):
        assert sorted(map(tuple, f(g).collect())) == sorted(map(tuple, f(h).collect()))


def test_engine_and_budget(spark):
    from meshline.engine import GraphEngine, benchmark

    g = graph(spark, 4, [call(0, 1), call(1, 2), call(3, 1)], {0: "alpha", 1: "beta", 2: "gamma", 3: "delta"})
    e = GraphEngine(g)
    assert len(e.callers("beta").nodes) == 3 and len(e.callees("beta").nodes) == 2
    assert e.path("alpha", "gamma") == ["n00", "n01", "n02"] and e.path("gamma", "alpha") is None
    assert {r["id"] for r in e.impact("gamma").collect()} == {"n00", "n01", "n02", "n03"}
    small = e.query("beta", traverse.Options(depth=1), token_budget=60)
    assert small.seeds == ["n01"] and "token_budget" in small.reasons and small.estimated_tokens <= 60
    with pytest.raises(LookupError):
        e.resolve("nothing")
    assert set(benchmark(lambda: None, 5)) == {"median", "p95"}


def test_hubs_apart_and_split_again(spark):
    g = cliques(spark)
    part = community.exclude_hubs(g, community.cut(metrics.symmetric(g)), 90.0)
    assert part.count() == 11 and part.select("id").distinct().count() == 11
    whole = g.nodes.select("id", F.lit("all").alias("community"))
    finer = community.split_again(g, whole, most_size=6)
    assert sorted(r["count"] for r in finer.groupBy("community").count().collect()) == [1, 5, 5]
    n = spark.createDataFrame([('{"community": 7}',), ('{"community": "7"}',), ('{"community": 7}',), ("{}",), (None,)], "metadata string")
    assert {(r["community_type"], r["size"]) for r in community.preserved(n).collect()} == {("integer", 2), ("string", 1)}


def test_notes_worktrees_and_compaction(spark, tmp_path):
    from meshline.sources import records

    d = tmp_path / "notes"
    d.mkdir()
    note = "---\nevent_id: e1\ncreated: 2025-01-01T00:00:00Z\noutcome: useful\nsource_nodes:\n- a\n- b\n---\nBecause.\n"
    (d / "x.md").write_text(note)
    (d / "copy.md").write_text(note)
    rows = records.read_notes(spark, str(d)).collect()
    assert [(r["event_id"], r["source_nodes"], r["answer"]) for r in rows] == [("e1", ["a", "b"], "Because.")]
    (d / "other.md").write_text(note.replace("Because", "No"))
    with pytest.raises(Exception, match="differing copies"):
        records.read_notes(spark, str(d)).collect()
    assert records.worktrees("worktree /a\0HEAD x\0branch refs/heads/m\0\0worktree /b\0detached\0") == [("/a", "m"), ("/b", None)]
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    told = records.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert told["files_before"] == 5 and told["files_after"] == 1 and spark.read.parquet(str(tmp_path / "u")).count() == 100


def test_semantic_and_office(spark):
    import io
    import zipfile

    from meshline.sources import semantic

    ok = json.dumps({"nodes": [{"id": "a", "evidence": "cat"}, {"id": "b", "evidence": "sat"}], "edges": [{"source": "a", "target": "b", "evidence": "cat sat"}], "hyperedges": [{"nodes": ["a", "b"], "evidence": "cat"}]})
    rows = semantic.apply_semantic(spark.createDataFrame([(1, "the cat sat", ok), (2, "no", ok), (3, None, ok)], "doc_id bigint, text string, reply string")).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 8 and [r["record"] for r in rows if r["doc_id"] == 2] == ["diagnostic"]
    assert semantic.data_facts("x.json", '{"a": {"b": [1, "x"]}}') == [("a.b[0]", "1"), ("a.b[1]", "x")]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:document>')
    assert semantic.office_text("a.docx", buf.getvalue()) == "## T\ntext"


def test_facts_of_all_kinds_of_files(spark, tmp_path):
    rows = [("a/tool", "#!/usr/bin/env python3\ndef f(): pass\n"), ("a/b.pyi", "def g() -> int: ...\n"), ("a/c.py", "def h(): pass\n"), ("a/q.sql", "create table t (x int);"), ("a/package.json", '{"name": "p", "dependencies": null}'), ("a/x.html", "<title>T</title>"), ("a/r.txt", "Head\n====\n"), ("a/none.py", None), ("a/run", "#!/bin/sh\necho\n")]
    spark.createDataFrame([(p, c, 1) for p, c in rows], "path string, content string, generation bigint").write.parquet(str(tmp_path / "files.parquet"))
    got = {(r["path"], r["fact"], r["name"]) for r in exchange.x11_python_facts(spark, str(tmp_path)).collect()}
    assert got == {("a/tool", "function", "f"), ("a/b.pyi", "function", "g"), ("a/c.py", "function", "h"), ("a/q.sql", "table", "t"), ("a/package.json", "diagnostic", "TypeError"), ("a/x.html", "title", "T"), ("a/r.txt", "heading", "Head")}


def test_node_link_restores_whole_records(spark):
    g = graph(spark, 3, [call(0, 1, 2.0), call(1, 2, 1.0, False)], {0: 'a "quoted" é'})
    rows = export.node_link_rows(g).collect()
    doc = {"directed": True, "multigraph": True, "nodes": [json.loads(r["json"]) for r in rows if r["record"] == "node"], "links": [json.loads(r["json"]) for r in rows if r["record"] == "link"]}
    nodes, edges = node_link.parse_node_link(json.dumps(doc))
    n = node_link.restored(spark.createDataFrame(nodes, NODES), ("id", "label", "kind", "file"))
    e = node_link.restored(spark.createDataFrame(edges, EDGES), ("source", "target", "relation", "directed"))
    assert sorted(map(str, n.collect())) == sorted(map(str, g.nodes.collect())) and sorted(map(str, e.collect())) == sorted(map(str, g.edges.collect()))
    doc["nodes"][0]["original"]["label"] = "other"
    nodes, _ = node_link.parse_node_link(json.dumps(doc))
    with pytest.raises(Exception, match="contradicts"):
        node_link.restored(spark.createDataFrame(nodes, NODES), ("id", "label", "kind", "file")).collect()


def test_lookups(spark):
    g = graph(spark, 4, [call(0, 1), (0, 2, 1.0, True, "imports"), (0, 3, 1.0, True, "imports_from")], {0: "Alpha.run", 1: "beta"})
    got = [(r["query"], r["pos"], r["id"], r["truncated"]) for r in lookup.basic_search(g.nodes, ["alp zzz", "beta", "label"], 1).collect()]
    assert sorted(got) == [("alp zzz", 0, "n00", False), ("beta", 0, "n01", False), ("label", 0, "n02", True)]
    with pytest.raises(ValueError):
        lookup.basic_search(g.nodes, ["a b c d e f g h i"])
    n = spark.createDataFrame([("1", "a.py", "function", 1, "a.py"), ("2", "f", "function", 3, "a.py"), ("3", "m", "module", None, "b.py"), ("4", "n", "file", 1, "b.py"), ("5", "x", "class", 2, "c.py")], "id string, label string, kind string, line int, file string")
    roots = {r["file"]: (r["id"], r["n_roots"]) for r in lookup.file_roots(n, spark.createDataFrame([("a.py",), ("b.py",), ("c.py",), ("d.py",), (None,)], "file string")).collect()}
    assert roots == {"a.py": ("1", 1), "b.py": (None, 2), "c.py": ("5", 0), "d.py": (None, 0)}
    refs = spark.createDataFrame([("r1", "n00", None, "extends", "x")], "id string, source string, resolved_target string, relation string, label string")
    asked = spark.createDataFrame([("n00", t) for t in ("imports", "IMPORTS", "import", "xten", "none", "call")], "id string, text string")
    told = {r["text"]: (r["relation"], r["n"]) for r in lookup.resolve_relations(asked, lookup.incident_relations(g, refs)).collect()}
    assert told == {"imports": ("imports", 1), "IMPORTS": ("imports", 1), "import": (None, 2), "xten": ("extends", 1), "none": ("none", 0), "call": ("calls", 1)}
    assert lookup.neighbors_by_shorthand(g, refs, "n00", "call").nodes == ["n00", "n01"] and lookup.neighbors_by_shorthand(g, None, "n00", "none").nodes == ["n00"]
    with pytest.raises(LookupError):
        lookup.neighbors_by_shorthand(g, refs, "n00", "import")
    with pytest.raises(ValueError, match="edges"):
        metrics.bounded_snapshot(g, refs, 9, 2, 9, 10**6)
    assert metrics.bounded_snapshot(g, refs, 9, 9, 9, 10**6)[0] is g


def test_saved_answers(spark):
    h = {k: k * 64 for k in "abc"}
    node = lambda i, f, x: (i, f, x)
    nodes, files = "node_id string, file string, node_hash string", "file string, index_hash string, disk_hash string"
    then = spark.createDataFrame([node("n1", "f1", "x"), node("n2", "f2", "x"), node("n3", "f3", "x"), node("n4", "f4", "x")], nodes)
    was = spark.createDataFrame([("f1", h["a"], h["a"]), ("f2", h["a"], h["a"]), ("f3", h["a"], h["b"]), ("f4", h["a"], None)], files)
    events = spark.createDataFrame([("e1", 10, "useful", ["n1", "n1", None]), ("e2", 10, "dead_end", ["n1", "n2"]), ("e3", 10, None, ["n3", "n4", "gone"])], "event_id string, at bigint, outcome string, nodes array<string>")
    saved = memory.save_records(events, then, was, "g")
    now = spark.createDataFrame([("f1", h["a"], h["a"]), ("f2", h["c"], h["c"]), ("f3", h["b"], h["b"]), ("f4", h["a"], h["a"])], files)
    status = memory.source_status(saved, then, now, "g")
    got = {(r["event_id"], r["node_id"]): r["status"] for r in status.collect()}
    assert got == {
        ("e1", "n1"): "current", ("e2", "n1"): "current", ("e2", "n2"): "stale (indexed source changed)", ("e3", "n3"): "stale (source differed from indexed bytes when saved)",
        ("e3", "n4"): "unverified (source fingerprint unavailable)", ("e3", "gone"): "stale (node missing)",
    }
    kinds = {r["node_id"]: (r["class"], r["positive"], r["negative"], r["verified"], r["stale"]) for r in memory.classified(status, 100, 0.0).collect()}
    assert kinds == {"n1": ("contested", 1, 1, 1, 0), "n2": ("stale", 0, 0, 0, 1), "n3": ("stale", 0, 0, 0, 1), "n4": ("unmarked", 0, 0, 0, 0), "gone": ("stale", 0, 0, 0, 1)}
    hits = spark.createDataFrame([(0, "n1"), (1, "n4"), (2, "n2")], "pos int, id string")
    assert [r["id"] for r in memory.overlay(hits, memory.classified(status, 100)).collect()] == ["n1", "n2"]
    assert [r["id"] for r in memory.overlay(hits, memory.classified(status, 100), 120).collect()] == ["n1"]
    with pytest.raises(Exception, match="no valid event"):
        memory.save_records(spark.createDataFrame([("e1", 1, "odd", ["n1"])], events.schema), then, was, None).collect()


def levels_of(steps, first, depth):
    """{id: depth} of a plain breadth-first search."""
    at = dict.fromkeys(first, 0)
    front = list(first)
    for k in range(1, depth + 1):
        front = sorted({y for x in front for y in steps.get(x, ())} - set(at))
        at |= dict.fromkeys(front, k)
    return at


@pytest.mark.parametrize("most", [10**6, 0])
def test_impact_of_many_seeds(spark, monkeypatch, most):
    monkeypatch.setattr(traverse, "MOST_NODES", most, raising=False)
    rng = random.Random(6)
    edges = [call(rng.randrange(70), rng.randrange(70), 1, rng.random() < 0.8) for _ in range(150)] + [(rng.randrange(70), rng.randrange(70), 1, True, "contains") for _ in range(30)]
    edges += [(1, 2, 1, True, "contains"), (2, 1, 1, True, "method"), call(3, 3)]
    g = graph(spark, 70, edges)
    calls, below = {}, {}
    for a, b, _, d, rel in edges:
        if rel == "calls":
            calls.setdefault(b, set()).add(a)
            _ = d or calls.setdefault(a, set()).add(b)
        else:
            below.setdefault(a, set()).add(b)
    roots = spark.createDataFrame([(f"n{k:02d}",) for k in range(70)] + [("gone",)], "id string")
    got = {(r["seed"], r["id"]): r["depth"] for r in traverse.impact(g, roots, 3).collect()}
    want = {(f"n{s:02d}", f"n{k:02d}"): d for s in range(70) for k, d in levels_of(calls, levels_of(below, [s], 70), 3).items()}
    assert got == want | {("gone", "gone"): 0}


def test_impact_keeps_no_level_of_pairs(spark, monkeypatch):
    """Many seeds through one hub: pairs are rows of the result and of nothing else."""
    kept, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: kept.append(x := cut(df)) or x)
    g = graph(spark, 81, [call(0, k) for k in range(1, 41)] + [call(k, 0) for k in range(41, 81)])
    assert traverse.impact(g, g.ids, 2).count() == 81 + 40 + 40 + 40 * 40
    assert max(df.count() for df in kept) <= 81


def test_walk_keeps_no_level_of_pairs(spark, monkeypatch):
    kept, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: kept.append(x := cut(df)) or x)
    g = graph(spark, 81, [call(k, 0, 1, k % 2 > 0) for k in range(41, 81)] + [call(0, k) for k in range(1, 41)])
    got = {(r["seed"], r["id"]): r["depth"] for r in traverse.walk(g, g.ids, 2).collect()}
    out = {0: {*range(1, 41), *range(42, 81, 2)}} | {k: {0} for k in range(41, 81)}
    assert got == {(f"n{s:02d}", f"n{k:02d}"): d for s in range(81) for k, d in levels_of(out, [s], 2).items()}
    assert max(df.count() for df in kept) <= 81


def test_leiden_visits_what_changed():
    """Weights far above the least gain, communities in one part each, and few visits of each node."""
    rng = random.Random(5)
    pairs = {(a, rng.randrange(a)) for a in range(1, 400) for _ in range(4)}
    adj = {k: {} for k in range(400)}
    for a, b in pairs:
        adj[a][b] = adj[b][a] = 1e6
    seen, near = [], community._Level.near
    community._Level.near = lambda x, i: seen.append(x.n) or near(x, i)
    try:
        got = community.kernel(adj, 2e6 * len(pairs), algorithm="leiden")
    finally:
        community._Level.near = near
    assert seen.count(400) < 20 * 400
    quality = lambda part: sum(adj[i].get(j, 0) / (2e6 * len(pairs)) - len(adj[i]) * len(adj[j]) / (2 * len(pairs)) ** 2 for i in adj for j in adj if part[i] == part[j])
    assert quality(got) > quality(community.kernel(adj, 2e6 * len(pairs))) - 0.01
    for c in set(got.values()):
        mine = {i for i in got if got[i] == c}
        todo = [min(mine)]
        left = mine - set(todo)
        while todo:
            todo += (new := left & set(adj[todo.pop()]))
            left -= new
        assert not left


def test_report_of_heavy_weights(spark):
    from meshline.engine import GraphEngine

    edges = [call(a, b, 1e6, False) for base in (0, 4) for a in range(base, base + 4) for b in range(base, a)]
    report = GraphEngine(graph(spark, 8, [*edges, call(3, 4, 1.0, False)])).report()
    assert report.count(": 4 nodes") == 2
