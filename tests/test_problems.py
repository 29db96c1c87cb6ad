"""Orphans, hierarchies and heavy keys against brute force on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meshline.functions.bitmaps import Bitmap
from meshline.operators import heavy_keys, hierarchy, orphans
from meshline.operators.components import connected_components
from meshline.session import cut

NODES = "id string, binding_key string, generation bigint, deleted boolean, extra int"
REFS = "id string, source string, resolved_target string, candidate_keys array<string>, generation bigint, indexed_at timestamp, field string"
ALIASES = "node_id string, binding_key string"
STUBS = "id string, binding_key string, generation bigint"


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)))
def test_bitmap_is_a_set(a, b):
    x, y = Bitmap.of(sorted(a)), Bitmap.of(sorted(b))
    assert set(x.codes().tolist()) == a
    assert set((x | y).codes().tolist()) == a | b
    assert set(x.and_not(y).codes().tolist()) == a - b


def test_bitmap_dense_containers():
    a, b = np.arange(0, 60_000, 2), np.arange(0, 60_000, 3)
    assert set(Bitmap.of(a).and_not(Bitmap.of(b)).codes().tolist()) == set(a.tolist()) - set(b.tolist())
    assert set((Bitmap.of(a) | Bitmap.of(b)).codes().tolist()) == set(a.tolist()) | set(b.tolist())
    assert set(Bitmap.of(a).and_not(Bitmap.of([2, 4])).codes().tolist()) == set(a.tolist()) - {2, 4}


def _orphans(spark, refs, nodes, aliases=(), stubs=()):
    out = orphans.orphan_references(spark.createDataFrame(list(refs), REFS), spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(aliases), ALIASES), spark.createDataFrame(list(stubs), STUBS))
    return {(r["ref_id"], r["field"], r["ref_key"]) for r in out.collect()}


def test_orphans_cases(spark):
    nodes = [("a", "ka", 1, None, 0), ("a", "ka2", 3, False, 0), ("late", "kl", 5, False, 0), ("dead", "kd", 1, False, 0), ("dead", "kd", 2, True, 0), ("again", None, 1, True, 0), ("again", None, 4, False, 0)]
    refs = [
        ("r1", "a", "late", ["ka", "ka2", None, "ka"], 4, None, "x"), ("r1", "a", "late", ["ka", "ka2", None, "ka"], 4, None, "x"), ("r1", "old", None, None, 1, None, "x"),
        ("r2", "dead", None, [], 9, None, None), ("r3", "again", "ext", None, 1, None, None), ("r4", None, "", ["alias", "kl", "ks"], 5, None, None),
    ]
    got = _orphans(spark, refs, nodes, [("a", "alias"), ("dead", "gone")], [("ext", "ks", 2)])
    # r3: "again" existed at generation 1 and its current row is live, so it is known; the stub came later
    assert got == {("r1", "resolved_target", "late"), ("r1", "candidate_keys", "ka"), ("r2", "source", "dead"), ("r3", "resolved_target", "ext"), ("r4", "resolved_target", "")}


def test_orphans_empty(spark):
    assert _orphans(spark, [], []) == set()
    assert _orphans(spark, [("r", "s", None, ["k"], 1, None, None)], []) == {("r", "source", "s"), ("r", "candidate_keys", "k")}


def test_orphans_random(spark):
    rng = random.Random(4)
    nodes = [(f"n{rng.randrange(40)}", f"k{rng.randrange(30)}", g, rng.choice([None, False, True]), 0) for g in range(1, 6) for _ in range(20)]
    nodes = list({(n[0], n[2]): n for n in nodes}.values())
    aliases = [(f"n{rng.randrange(50)}", f"k{rng.randrange(60)}") for _ in range(30)]
    refs = [(f"r{i}", f"n{rng.randrange(60)}", None, [f"k{rng.randrange(60)}" for _ in range(3)], rng.randrange(1, 7), None, None) for i in range(200)]
    cur, first = {}, {}
    for n in nodes:
        first[n[0]] = min(first.get(n[0], 99), n[2])
        if n[0] not in cur or cur[n[0]][2] < n[2]:
            cur[n[0]] = n
    live = {i: first[i] for i, n in cur.items() if not n[3]}
    keys = defaultdict(lambda: 99)
    for i, since in live.items():
        keys[cur[i][1]] = min(keys[cur[i][1]], since)
    for i, k in aliases:
        if i in live:
            keys[k] = min(keys[k], live[i])
    want = {(r[0], "source", r[1]) for r in refs if live.get(r[1], 99) > r[4]} | {(r[0], "candidate_keys", k) for r in refs for k in r[3] if keys[k] > r[4]}
    assert _orphans(spark, refs, nodes, aliases) == want


def _depths(links):
    parent, out = dict(links), {}
    for x in set(parent) | set(parent.values()):
        at, d, seen = x, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            at, d = parent[at], d + 1
        out[x] = ("", -1) if at in seen else (at, d)
    return out


def test_hierarchy_random_with_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "PER_BUCKET", 40)
    rng = random.Random(2)
    links = [(f"c{i}", f"c{i + 1}") for i in range(150)]  # one long chain
    links += [(f"l{i}", f"l{(i + 1) % 90}") for i in range(90)]  # one long cycle
    links += [(f"x{i}", rng.choice(["c7", "l3", f"x{rng.randrange(i)}" if i else "top"])) for i in range(200)]
    links += [("self", "self"), ("under", "self")]
    df = spark.createDataFrame(links + links[:20] + [(None, "a"), ("b", None)], "child string, parent string")
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.roots_and_depths(df).collect()}
    assert got == _depths(links)


def test_hierarchy_hot_key_and_empty(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "PER_BUCKET", 50)
    links = [(f"k:f:{i}", "k:f:root") for i in range(300)]
    df = spark.createDataFrame(links, "child string, parent string")
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.roots_and_depths(df, hierarchy.file_locality).collect()}
    assert got == _depths(links)
    assert hierarchy.roots_and_depths(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_paths_and_descendants(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("y", "z"), ("z", "y")]
    df = spark.createDataFrame(links, "child string, parent string")
    depths = hierarchy.cut(hierarchy.roots_and_depths(df))
    rows = {r["node_id"]: (r["path"], r["n_descendants"]) for r in hierarchy.full_paths(depths, hierarchy.ancestor_pairs(df, depths)).collect()}
    assert rows["d"] == (["a", "b", "c", "d"], 0) and rows["a"] == (["a"], 4) and rows["b"] == (["a", "b"], 3) and rows["y"] == (None, None)


def test_containment_uses_current_rows(spark):
    rows = [("e", "p1", "c", "contains", 1), ("e", "p2", "c", " Contains", 2), ("f", "p", "d", "contains", 1), ("f", "p", "d", "calls", 2), ("g", None, "x", "method", 1)]
    df = spark.createDataFrame(rows, "id string, source string, target string, relation string, generation bigint")
    assert {tuple(r) for r in hierarchy.containment_links(df).collect()} == {("c", "p2")}


def test_heavy_keys(spark):
    rng = random.Random(5)
    rows = [("calls", "hot" if rng.random() < 0.4 else f"t{rng.randrange(300)}", rng.choice([None, *(f"s{k}" for k in range(50))]), rng.choice([None, 1, 2, 3])) for _ in range(3000)]
    rows += [(None, None, "s", 1)] * 40
    df = spark.createDataFrame(rows, "relation string, target string, source string, generation bigint")
    got = heavy_keys.tree_aggregate(df, ["relation", "target"], "source", "generation", chunk_rows=20, fan_in=4)
    n, s, last = Counter(), defaultdict(set), {}
    for r in rows:
        k = r[:2]
        n[k] += 1
        s[k] |= {r[2]} - {None}
        last[k] = max(last.get(k, 0), r[3] or 0)
    assert {(r[0], r[1]): (r["n_rows"], r["n_distinct"], r["last"] or 0) for r in got.collect()} == {k: (n[k], len(s[k]), last[k]) for k in n}
    heavy = {tuple(r) for r in heavy_keys.heavy_keys(got, ["relation", "target"], len(rows)).collect()}
    assert heavy == {k for k in n if n[k] * 100 >= len(rows)}
    assert heavy_keys.tree_aggregate(df.limit(0), ["relation", "target"], "source", "generation").count() == 0


def test_components(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("b1", "b2"), ("b2", "b1"), ("s", "s"), (None, "a1")]
    nodes = spark.createDataFrame([(x,) for x in ["alone", "s"]], "id string")
    got = {r["id"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"a{i}": "a0" for i in range(31)} | {"b1": "b1", "b2": "b1", "alone": "alone", "s": "s"}


def test_checkpoints_of_a_loop_do_not_multiply_estimates(spark):
    df = spark.range(4).selectExpr("id", "id as v")
    digits = []
    for _ in range(4):
        df = cut(df.join(df.withColumnRenamed("v", "w"), "id").selectExpr("id", "least(v, w) as v"))
        digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert digits[-1] <= digits[0] and df.count() == 4
