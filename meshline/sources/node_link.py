"""Node-link JSON and native snapshots: strict readers, checks, external stubs, groups."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph

MOST_BYTES = 256 << 20
IMPORTS = ("imports", "imports_from", "re_exports")
NODE_SCHEMA = "id string, label string, kind string, file string, line int, end_line int, qualified_name string, binding_key string, metadata string, repo string"
EDGE_SCHEMA = "id string, source string, target string, relation string, directed boolean, file string, line int, confidence string, metadata string, ref_id string"


def strict_json(text: str):
    """Parsed JSON; a key that occurs twice in one object is an error."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate JSON key")
        return out

    return json.loads(text, object_pairs_hook=pairs)


def typed_id(value) -> str:
    """A string id as it is, an integer as ``integer:<n>``; others are errors."""
    if isinstance(value, bool) or not isinstance(value, (str, int)) or value == "":
        raise ValueError(f"an id must be a string or an integer: {value!r}")
    return value if isinstance(value, str) else f"integer:{value}"


def location(text: str | None) -> tuple[int | None, int | None]:
    """Lines of ``L12``, ``L12-L15`` or ``L12-15``; other texts have none, a reversed or zero range is an error."""
    m = re.fullmatch(r"L(\d+)(?:-L?(\d+))?", text or "")
    if not m:
        return None, None
    a, b = int(m.group(1)), int(m.group(2) or m.group(1))
    if a < 1 or b < a:
        raise ValueError(f"bad source location {text!r}")
    return a, b


def _first(item: dict, *names: str):
    found = [item[n] for n in names if item.get(n) is not None]
    if len({json.dumps(x) for x in found}) > 1:
        raise ValueError(f"conflicting values of {names}")
    return found[0] if found else None


def parse_node_link(text: str) -> tuple[list[tuple], list[tuple]]:
    """Node and edge rows of one node-link document, its groups as nodes with ``member_of`` edges."""
    doc = strict_json(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("nodes"), list) or ("links" in doc) == ("edges" in doc):
        raise ValueError("a node-link document needs nodes and exactly one of links and edges")
    if not isinstance(doc.get("directed"), bool) or not isinstance(doc.get("multigraph"), bool):
        raise ValueError("directed and multigraph must be booleans")
    nodes, edges, seen = [], [], set()
    for n in doc["nodes"]:
        i = typed_id(n.get("id"))
        if i in seen:
            raise ValueError(f"two nodes have the id {i!r}")
        seen.add(i)
        a, b = location(n.get("source_location"))
        rest = {k: v for k, v in n.items() if k not in ("id", "label", "name", "file_type", "kind", "source_file", "source_location", "qualified_name")}
        nodes.append((i, str(_first(n, "label", "name") or i), _first(n, "kind", "file_type") or "concept", _first(n, "source_file", "source", "path"), a, b, n.get("qualified_name"), None, json.dumps(rest, sort_keys=True), None))
    pairs = set()
    for k, e in enumerate(doc.get("links", doc.get("edges"))):
        s, t = typed_id(_first(e, "source", "from")), typed_id(_first(e, "target", "to"))
        if ("_src" in e) != ("_tgt" in e):
            raise ValueError("_src and _tgt come together")
        if "_src" in e:
            o = typed_id(e["_src"]), typed_id(e["_tgt"])
            if {s, t} != set(o):
                raise ValueError("_src and _tgt must be the ends of the edge")
            s, t = o
        directed = e.get("directed", doc["directed"])
        if not {s, t} <= seen:
            raise ValueError(f"an edge has no node at one end: {s!r}, {t!r}")
        if doc["multigraph"] and "key" not in e:
            raise ValueError("an edge of a multigraph needs a key")
        name = (s, t) if directed else tuple(sorted((s, t)))
        name += (json.dumps(e.get("key")),) if doc["multigraph"] else ()
        if name in pairs:
            raise ValueError(f"two edges of {name}")
        pairs.add(name)
        line, _ = location(e.get("source_location"))
        rest = {x: v for x, v in e.items() if x not in ("source", "from", "target", "to", "relation", "type", "confidence", "directed", "source_file", "source_location", "_src", "_tgt")}
        edges.append((f"edge:{k}", s, t, _first(e, "relation", "type") or "related_to", bool(directed), e.get("source_file"), line, e.get("confidence") or "UNKNOWN", json.dumps(rest, sort_keys=True), None))
    for k, gr in enumerate(doc.get("groups") or doc.get("hyperedges") or []):
        members = [typed_id(x["id"] if isinstance(x, dict) else x) for x in _first(gr, "nodes", "members", "node_ids") or []]
        if not members or not set(members) <= seen:
            raise ValueError("a group needs members that exist")
        g = typed_id(gr["id"]) if "id" in gr else f"group:{k}"
        nodes.append((g, str(_first(gr, "label", "name") or g), "group", None, None, None, None, None, "{}", None))
        edges += [(f"member:{k}:{j}", x, g, "member_of", False, None, None, gr.get("confidence") or "UNKNOWN", json.dumps({"ordinal": j}), None) for j, x in enumerate(members)]
    return nodes, edges


def parse_snapshot(text: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of one native snapshot; fields outside the schema are errors."""
    doc = strict_json(text)
    extra = set(doc) - {"schema_version", "generation", "kind", "root", "nodes", "edges", "metadata"}
    if extra or doc.get("schema_version") != 1 or doc.get("kind") not in ("empty", "native", "imported"):
        raise ValueError(f"no snapshot of version 1: {sorted(extra)}")
    out = []
    for name, columns in (("nodes", NODE_COLUMNS), ("edges", EDGE_COLUMNS)):
        rows = []
        for x in doc.get(name, []):
            if set(x) - set(columns):
                raise ValueError(f"unknown fields in {name}: {sorted(set(x) - set(columns))}")
            rows.append(tuple(json.dumps(x[c], sort_keys=True) if c == "metadata" and not isinstance(x.get(c), str) and c in x else x.get(c) for c in columns))
        out.append(rows)
    ids = [r[0] for r in out[0]]
    if len(set(ids)) != len(ids) or not {e for r in out[1] for e in r[1:3]} <= set(ids):
        raise ValueError("ids must be unique and edges must have both ends")
    return out[0], out[1]


def read_documents(spark: SparkSession, path: str, kind: str = "node_link") -> Graph:
    """The graph of all documents under ``path``, each parsed by one task; a malformed one fails the read."""
    parse = {"node_link": parse_node_link, "snapshot": parse_snapshot}[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")

    def rows(which: int, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for p, n, c in zip(b["path"], b["length"], b["content"], strict=True):
                    if n > MOST_BYTES:
                        raise ValueError(f"{p}: {n} bytes; the bound is {MOST_BYTES}")
                    out = pd.DataFrame(parse(bytes(c).decode())[which], columns=columns)
                    for k in ("line", "end_line"):
                        if k in out:
                            out[k] = out[k].astype("Int32")
                    yield out

        return run

    return Graph(files.mapInPandas(rows(0, NODE_COLUMNS), NODE_SCHEMA), files.mapInPandas(rows(1, EDGE_COLUMNS), EDGE_SCHEMA))


def external_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): missing targets of imports whose source is declared; each becomes an external node."""
    wanted = edges.where(F.lower(F.trim("relation")).isin(*IMPORTS)).join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    return wanted.where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti")


def validate(g: Graph) -> None:
    """Raise for empty or repeated node ids and for edges without both ends."""
    bad = g.nodes.groupBy("id").count().where("count > 1 or id is null or id = ''").limit(3).collect()
    if bad:
        raise ValueError(f"node ids must be unique and not empty: {[r['id'] for r in bad]}")
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id")).join(g.nodes.select("id"), "id", "left_anti").limit(3).collect()
    if ends:
        raise ValueError(f"edges without a node at one end: {[r['id'] for r in ends]}")


def restored(rows: DataFrame, checked: tuple[str, ...]) -> DataFrame:
    """Rows read from a node-link document, each replaced by the whole record it carries in ``metadata.original``.

    A carried record must agree with the row in the ``checked`` columns, else it
    is an error; rows without one stay as they were read.
    """
    held = F.from_json(F.get_json_object("metadata", "$.original"), rows.schema)
    x = rows.withColumn("_held", held)
    differ = reduce(Column.__or__, [~F.col(f"_held.{c}").eqNullSafe(F.col(c)) for c in checked])
    bad = F.col("_held").isNotNull() & differ
    picked = F.when(bad, F.raise_error(F.concat(F.lit("a carried record contradicts its row: "), F.coalesce(F.col("id"), F.lit("null")))).cast(rows.schema)).when(F.col("_held").isNotNull(), F.col("_held")).otherwise(F.struct(*rows.columns))
    return x.select(picked.alias("_row")).select("_row.*")
