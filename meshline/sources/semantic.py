"""Supplied semantic graphs: validation against the text they quote, and their records; YAML, JSON and Office text."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from meshline.sources.node_link import strict_json

MOST_NODES, MOST_EDGES, MOST_GROUPS = 128, 256, 32
MOST_FACTS, MOST_DEPTH = 20_000, 64
RECORDS = "doc_id bigint, record string, id string, label string, source string, target string, relation string, evidence string"


def validated(text: str, reply: str) -> list[tuple]:
    """Records of one supplied graph: (record, id, label, source, target, relation, evidence).

    Every item must quote a literal passage of the text; edges and groups must
    name nodes that exist; sizes are bounded; anything else is an error.
    """
    doc = strict_json(reply)
    nodes, edges, groups = doc.get("nodes", []), doc.get("edges", []), doc.get("hyperedges", [])
    if len(nodes) > MOST_NODES or len(edges) > MOST_EDGES or len(groups) > MOST_GROUPS:
        raise ValueError("a supplied graph has at most 128 nodes, 256 edges and 32 groups")
    for x in (*nodes, *edges, *groups):
        if not x.get("evidence") or x["evidence"] not in text:
            raise ValueError("an item quotes no passage of its text")
    ids = [n["id"] for n in nodes]
    if len(set(ids)) != len(ids) or not {e for x in edges for e in (x["source"], x["target"])} | {i for x in groups for i in x["nodes"]} <= set(ids):
        raise ValueError("ids must be unique and ends must exist")
    out = [("node", n["id"], n.get("label", n["id"]), None, None, None, n["evidence"]) for n in nodes]
    out += [("mention", f"mentions:{k}", None, None, n["id"], "mentions", n["evidence"]) for k, n in enumerate(nodes)]
    out += [("edge", f"semantic:{k}", None, x["source"], x["target"], x.get("relation", "related_to"), x["evidence"]) for k, x in enumerate(edges)]
    for k, x in enumerate(groups):
        out.append(("group", f"group:{k}", x.get("label", f"group:{k}"), None, None, None, x["evidence"]))
        out += [("edge", f"member:{k}:{j}", None, i, f"group:{k}", "member_of", x["evidence"]) for j, i in enumerate(x["nodes"])]
    return out


def apply_semantic(docs: DataFrame) -> DataFrame:
    """Records of (doc_id, text, reply); a reply that does not validate gives one ``diagnostic`` record and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, reply in zip(b["doc_id"], b["text"], b["reply"], strict=True):
                if text is None or reply is None:
                    continue
                try:
                    rows += [(i, *r) for r in validated(text, reply)]
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((i, "diagnostic", None, str(e)[:200], None, None, None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])

    return docs.select("doc_id", "text", "reply").mapInPandas(run, RECORDS)


def scalars(value, path: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """Flattened scalars of nested data as (``a.b[i]``, text)."""
    if depth > MOST_DEPTH:
        raise ValueError(f"nested deeper than {MOST_DEPTH}")
    if isinstance(value, dict):
        for k, v in value.items():
            yield from scalars(v, f"{path}.{k}" if path else str(k), depth + 1)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from scalars(v, f"{path}[{k}]", depth + 1)
    else:
        yield path, value if isinstance(value, str) else json.dumps(value, default=str)


def data_facts(name: str, text: str) -> list[tuple[str, str]]:
    """Scalars of a JSON or, where a YAML parser is installed, a YAML text."""
    if name.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed") from e
        docs = list(yaml.safe_load_all(text))
        value = docs[0] if len(docs) == 1 else docs
    else:
        value = strict_json(text)
    out = list(scalars(value))
    if len(out) > MOST_FACTS:
        raise ValueError(f"more than {MOST_FACTS} facts")
    return out


def office_text(name: str, data: bytes) -> str:
    """Paragraphs of a .docx with its headings marked, or the cells of an .xlsx by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name.lower().endswith(".docx"):
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            out = []
            for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{w}p"):
                text = "".join(t.text or "" for t in p.iter(f"{w}t"))
                style = p.find(f"{w}pPr/{w}pStyle")
                level = style.get(f"{w}val", "") if style is not None else ""
                out.append("#" * int(level[-1]) + " " + text if level.startswith("Heading") and level[-1:].isdigit() else text)
            return "\n".join(out)
        s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{s}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")]
        rows = []
        for sheet in sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")):
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{s}row"):
                cells = []
                for c in row.iter(f"{s}c"):
                    v = c.find(f"{s}v")
                    cells.append("" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                rows.append("\t".join(cells))
        return "\n".join(rows)
