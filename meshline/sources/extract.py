"""Facts from documents and sources: headings, links, prose rules, SQL, manifests and Python definitions."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.functions.text import cut_label, relative_path

FACT = "path string, fact string, name string, target string, level int, line int"
COLUMNS = ["path", "fact", "name", "target", "level", "line"]
# Phrases that mark a rationale.
RATIONALE = ("because ", "rationale:", "decision:", "trade-off", "tradeoff", "we chose ", "we use ")
_LINK = re.compile(r"(?<!!)\[([^\]\n]+)\]\(([^)\s]+)[^)\n]*\)")
_WIKI = re.compile(r"\[\[([^\]|#\n]+)(?:#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]")
_URL = re.compile(r"https?://[^\s<>()\"'`\]]+")
_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_RST_LINK = re.compile(r"`([^`<]+) <([^>`]+)>`_{0,2}")


def prose(line: str, n: int) -> list[tuple]:
    """Links, mentions and rationale of one line of prose."""
    out = [("link", m.group(1), m.group(2), None, n) for m in _LINK.finditer(line)]
    out += [("wikilink", (m.group(2) or m.group(1)).strip(), m.group(1).strip(), None, n) for m in _WIKI.finditer(line)]
    out += [("url", m.group().rstrip(".,;:"), m.group().rstrip(".,;:"), None, n) for m in _URL.finditer(line)]
    out += [("mention", m.group(1).strip(), None, None, n) for m in _CODE.finditer(line)]
    if any(w in line.lower() for w in RATIONALE):
        out.append(("rationale", cut_label(line, 512), None, None, n))
    return out


def markdown(text: str) -> list[tuple]:
    out, fence = [], None
    lines = text.split("\n")
    if lines and lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
        end = next(k for k in range(1, len(lines)) if lines[k].strip() == "---")
        out += [("front_matter", k.strip(), v.strip(), None, n + 1) for n, x in enumerate(lines[:end]) if ":" in x for k, v in [x.split(":", 1)]]
        lines = [""] * (end + 1) + lines[end + 1 :]
    for n, line in enumerate(lines, 1):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if m:
            fence = None if fence and line.strip().startswith(fence) else fence or m.group(1)[:3]
            continue
        if fence:
            continue
        h = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if h:
            out.append(("heading", h.group(2), None, len(h.group(1)), n))
        else:
            out += prose(line, n)
    return out


def plain(text: str) -> list[tuple]:
    """Underlined headings (three or more of one mark, as long as the title) and prose."""
    out, marks = [], []
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        under = lines[n].strip() if n < len(lines) else ""
        if line.strip() and len(under) >= 3 and len(set(under)) == 1 and under[0] in "=-~^\"" and len(under) >= len(line.strip()):
            if under[0] not in marks:
                marks.append(under[0])
            out.append(("heading", line.strip(), None, marks.index(under[0]) + 1, n))
        else:
            out += [("link", m.group(1).strip(), m.group(2), None, n) for m in _RST_LINK.finditer(line)]
            out += prose(line, n)
    return out


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute, self.tag, self.text, self.href = [], 0, None, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.mute += 1
        elif tag == "a" and dict(attrs).get("href"):
            self.href, self.link = dict(attrs)["href"], []
        elif tag == "title" or re.fullmatch("h[1-6]", tag):
            self.tag, self.text = tag, []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.mute = max(0, self.mute - 1)
        elif tag == "a" and self.href:
            self.out.append(("link", " ".join("".join(self.link).split()), self.href, None, None))
            self.href = None
        elif tag == self.tag:
            name = " ".join("".join(self.text).split())
            self.out.append(("title" if tag == "title" else "heading", name, None, None if tag == "title" else int(tag[1]), None))
            self.tag = None

    def handle_data(self, data):
        if not self.mute:
            if self.tag:
                self.text.append(data)
            if self.href:
                self.link.append(data)


def html(text: str) -> list[tuple]:
    p = _Html()
    p.feed(text)
    p.close()
    return p.out


_SQL_DEF = re.compile(r"\b(create|alter)\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|view|function|procedure|index|trigger)\s+(?:if\s+(?:not\s+)?exists\s+)?([\w.\"`\[\]]+)(?:\s+on\s+([\w.\"`\[\]]+))?", re.I)
_SQL_READ = re.compile(r"\b(?:from|join)\s+([\w.\"`\[\]]+)|\breferences\s+([\w.\"`\[\]]+)", re.I)
_SQL_CTE = re.compile(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)([\w\"]+)\s*(?:\([^)]*\)\s*)?as\s*(?:materialized\s*)?\(", re.I)


def sql(text: str) -> list[tuple]:
    """Definitions with what they read and refer to; names of common table expressions are no tables."""
    flat = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: " " * len(m.group()), text, flags=re.S)
    out, at = [], 0
    for stmt in flat.split(";"):
        line = text.count("\n", 0, at + len(stmt) - len(stmt.lstrip())) + 1
        d = _SQL_DEF.search(stmt)
        name = d.group(3).strip('"`[]') if d else None
        if d:
            out.append(("alters" if d.group(1).lower() == "alter" else d.group(2).lower(), name, None, None, line))
            if d.group(4):
                out.append(("indexes" if d.group(2).lower() == "index" else "triggers_on", name, d.group(4).strip('"`[]'), None, line))
        local = {m.group(1).strip('"').lower() for m in _SQL_CTE.finditer(stmt)}
        for m in _SQL_READ.finditer(stmt):
            t = (m.group(1) or m.group(2)).strip('"`[]')
            if t.lower() not in local and t.lower() not in ("select", "lateral", "unnest"):
                out.append(("references" if m.group(2) else "reads_from", name, t, None, line))
        at += len(stmt) + 1
    return list(dict.fromkeys(out))


def manifest(path: str, text: str) -> list[tuple]:
    """``package`` and ``depends_on`` facts of package.json, Cargo.toml, pyproject.toml and go.mod."""
    base = path.rsplit("/", 1)[-1]
    if base == "package.json":
        doc = json.loads(text)
        deps = {**doc.get("dependencies", {}), **doc.get("devDependencies", {}), **doc.get("peerDependencies", {})}
        return [("package", doc.get("name"), None, None, None)] + [("depends_on", doc.get("name"), k, None, None) for k in sorted(deps)]
    if base in ("Cargo.toml", "pyproject.toml"):
        doc = tomllib.loads(text)
        if base == "Cargo.toml":
            name, deps = doc.get("package", {}).get("name"), [k for s in ("dependencies", "dev-dependencies", "build-dependencies") for k in doc.get(s, {})]
        else:
            name, deps = doc.get("project", {}).get("name"), [re.split(r"[\s<>=!~;\[]", x, maxsplit=1)[0] for x in doc.get("project", {}).get("dependencies", [])]
        return [("package", name, None, None, None)] + [("depends_on", name, k, None, None) for k in sorted(set(deps))]
    if base == "go.mod":
        name = (re.search(r"(?m)^module\s+(\S+)", text) or [None, None])[1]
        return [("package", name, None, None, None)] + [("depends_on", name, m, None, None) for m in re.findall(r"(?m)^(?:require\s+|\s+)([\w./-]+\.[\w./-]+)\s+v", text)]
    return []


class _Python(ast.NodeVisitor):
    def __init__(self):
        self.out, self.scope = [], []

    def name(self, n: str) -> str:
        return ".".join([*self.scope, n])

    def _define(self, node, fact: str) -> None:
        full = self.name(node.name)
        self.out.append((fact, full, ".".join(self.scope) or None, len(self.scope), node.lineno))
        doc = ast.get_docstring(node)
        if doc:
            self.out.append(("docstring", full, cut_label(doc), None, node.lineno))
        for b in getattr(node, "bases", []):
            self.out.append(("inherits", full, ast.unparse(b), None, node.lineno))
        for x in node.decorator_list:
            self.out.append(("decorator", full, ast.unparse(x.func if isinstance(x, ast.Call) else x), None, x.lineno))
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node):
        self._define(node, "class")

    def visit_FunctionDef(self, node):
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        self.out += [("imports", a.asname or a.name, a.name, None, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node):
        base = "." * node.level + (node.module or "")
        self.out += [("imports", a.asname or a.name, f"{base}:{a.name}", None, node.lineno) for a in node.names]

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.out.append(("calls", ".".join(self.scope) or None, ast.unparse(node.func), None, node.lineno))
        self.generic_visit(node)


def python(text: str) -> list[tuple]:
    v = _Python()
    tree = ast.parse(text)
    doc = ast.get_docstring(tree)
    if doc:
        v.out.append(("docstring", None, cut_label(doc), None, 1))
    v.visit(tree)
    return v.out


def facts_of(path: str, text: str | None, head: str = "") -> list[tuple]:
    """Facts of one file by its extension; text that does not parse gives one ``diagnostic`` and nothing else."""
    if text is None:
        return []
    base = path.rsplit("/", 1)[-1]
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ("py" if "python" in text[:60] and text.startswith("#!") else "")
    try:
        if base in ("package.json", "Cargo.toml", "pyproject.toml", "go.mod"):
            return manifest(path, text)
        if ext in ("md", "markdown", "mdx"):
            return markdown(text)
        if ext in ("txt", "rst"):
            return plain(text)
        if ext in ("html", "htm"):
            return html(text)
        if ext == "sql":
            return sql(text)
        if ext in ("py", "pyi"):
            return python(text)
    except (SyntaxError, ValueError, RecursionError, AttributeError, TypeError, AssertionError) as e:
        return [("diagnostic", type(e).__name__, None, None, None)]
    return []


def extract(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, fact, name, target, level, line): the facts of all files, each read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([(p, *f) for p, t in zip(b[path], b[text], strict=True) for f in facts_of(p, t)], columns=COLUMNS)
            yield out.astype({"level": "Int32", "line": "Int32"})

    return files.select(path, text).mapInPandas(run, FACT)


def document_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, fact, name, target, level, line): Markdown facts of texts that carry no path of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([(i, *f) for i, t in zip(b["doc_id"], b["text"], strict=True) if t is not None for f in markdown(t)], columns=["doc_id", *COLUMNS[1:]])
            yield out.astype({"level": "Int32", "line": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, fact string, name string, target string, level int, line int")


def suffix_aliases(paths: DataFrame) -> DataFrame:
    """(path, alias): every suffix of a path at a folder boundary, without its extension, for links by short name."""
    stem = F.split(F.regexp_replace("path", "\\.[^./]*$", ""), "/")
    n = F.size(stem)
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(stem, n - k + 1, k), "/"))).alias("alias"))


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, target, resolved): relative links to files that exist; wiki names by their one unique suffix."""
    rel = F.udf(lambda p, t: relative_path(p, t.split("#", 1)[0]) if t else None, "string")
    direct = links.where("fact = 'link'").select("path", "target", rel("path", "target").alias("resolved")).join(paths.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    unique = suffix_aliases(paths).groupBy("alias").agg(F.count("*").alias("n"), F.min("path").alias("resolved")).where("n = 1")
    wiki = links.where("fact = 'wikilink'").select("path", "target").join(unique, F.col("target") == F.col("alias")).select("path", "target", "resolved")
    return direct.select("path", "target", "resolved").unionByName(wiki)


def dedupe_entities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and entities of one file, kind and trimmed label become the one of the smallest id; their edges follow.

    Self-edges that this makes and repeated ``mentions`` go.
    """
    soft = nodes.where("kind in ('concept', 'entity')").select("id", "file", "kind", F.trim("label").alias("label"))
    keep = soft.groupBy("file", "kind", "label").agg(F.min("id").alias("keep"))
    same = soft.alias("s").join(keep.alias("k"), F.col("s.file").eqNullSafe(F.col("k.file")) & (F.col("s.kind") == F.col("k.kind")) & F.col("s.label").eqNullSafe(F.col("k.label"))).select("s.id", "k.keep").where("id <> keep")
    out = edges
    for c in ("source", "target"):
        out = out.join(same.select(F.col("id").alias(c), F.col("keep").alias(f"{c}_keep")), c, "left").withColumn(c, F.coalesce(f"{c}_keep", c)).drop(f"{c}_keep")
    moved = out.where("source <> target").select(*edges.columns)
    mentions = moved.where("relation = 'mentions'").dropDuplicates(["source", "target"])
    return nodes.join(same.select("id"), "id", "left_anti"), moved.where("relation <> 'mentions'").unionByName(mentions)
