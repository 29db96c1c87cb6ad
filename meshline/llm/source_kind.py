"""Generated, minified, vendored and blob files: families of identifier-masked shingles and what marks them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.llm import lexers
from meshline.llm.syntax import language_of
from meshline.operators.components import connected_components
from meshline.session import cut
from meshline.tables import current_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BLOCK = 256
LONG_LINE = 200
CHANCE = 1e-6
# Folders of third-party copies and of build or tool output, compared without case.
VENDOR_DIRS = {"vendor", "_vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "extern", "external", "site-packages", "pods", "carthage", "deps"}
OUTPUT_DIRS = {"gen", "generated", "__generated__", "autogen", "dist"}
OUTPUT_PAIRS = {("build", "out"), ("build", "lib"), ("build", "classes"), ("build", "generated"), ("target", "debug"), ("target", "release"), ("target", "classes")}
# File names that tools and builds give.
OUTPUT_NAME = re.compile(r"[._]generated\.\w+$|\.(gen|g|pb|designer)\.\w+$|_pb2(_grpc)?\.pyi?$|_pb\.[cm]?[jt]sx?$|_(string|gen)\.go$|^zz_generated|^(package-lock|npm-shrinkwrap)\.json$|(^|[-.])lock\.json$|^(yarn|poetry|cargo|composer|gemfile|pipfile|bun)\.lock$|^(go\.sum|pnpm-lock\.yaml)$")
MINIFIED_NAME = re.compile(r"[.-]min\.[cm]?[jt]s$|\.(bundle|chunk|prod|packed)\.[cm]?[jt]s$|^[a-z]+[.-](?=[a-f]*\d)[0-9a-f]{6,}\w{0,3}\.[cm]?[jt]s$")
# How a comment at the head of a file begins that names a tool, or an upstream, as its author.
_LEAD = r"^[\s/#*;!<>=_-]*"
GENERATED_HEAD = re.compile(_LEAD + r"(code generated by|@generated\b|auto-?generated\b|generated (file|code|by|from|automatically)|machine[- ](written|generated|made)|automatisch (erzeugt|generiert)|g[ée]n[ée]r[ée] automatiquement|this (file|code) (was|is|has been) (auto-?|automatically |machine-)?(produced|generated|created|emitted|built|written) (by|from|automatically)|tables for \S+, (emitted|generated|produced) by|any manual change is overwritten)", re.I)
VENDORED_HEAD = re.compile(_LEAD + r"(third[- ]party copy|vendored (from|copy)|copied (verbatim|unchanged)? ?from|imported (unchanged|verbatim) from|bundled from|(verbatim|unmodified) copy of|mirrored from)", re.I)
_COMMENT = re.compile(r"\s*(//|#|/\*|\*|<!--|--|;|$)")
_DATA = re.compile(r"[\"'`][^\s\"'`]{40,}[\"'`]|(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*,\s*){8,}")
_MASK = re.compile(r"(?P<S>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<C>//[^\n]*|/\*.*?\*/|(?<![\w&])#(?!\[)[^\n]*)|(?P<N>\d[\w.]*)|(?P<I>[^\W\d]\w*)|(?P<O>[^\s\w])", re.S)
_ALL_WORDS = frozenset().union(*lexers.KEYWORDS.values())


def path_marks(path: str) -> set[str]:
    parts = path.lower().split("/")
    dirs, name = parts[:-1], parts[-1]
    marks = set()
    if any(d in VENDOR_DIRS for d in dirs):
        marks.add("vendored")
    if any(d in OUTPUT_DIRS for d in dirs) or any(p in OUTPUT_PAIRS for p in zip(dirs, dirs[1:])) or OUTPUT_NAME.search(name):
        marks.add("generated")
    if MINIFIED_NAME.search(name):
        marks.add("minified")
    return marks


def text_marks(text: str) -> set[str]:
    marks = set()
    for line in text.split("\n"):
        if not _COMMENT.match(line):
            break
        if GENERATED_HEAD.match(line):
            marks.add("generated")
        if VENDORED_HEAD.match(line):
            marks.add("vendored")
    if re.match(r'\s*\{\s*"(name|version|lockfileVersion|requires)"', text) and '"lockfileVersion"' in text and re.search(r'"(integrity|resolved|checksum)"', text):
        marks.add("generated")
    size = max(1, len(text.strip()))
    data = sum(len(m.group()) for m in _DATA.finditer(text))
    if data >= 0.6 * size:
        marks.add("blob")
    dense = sum(len(s) for s in text.split("\n") if len(s) > LONG_LINE and len(s.split()) < len(s) / 10)
    if dense - data >= 0.5 * size:
        marks.add("minified")
    return marks


def masked(text: str) -> tuple[list[str], str]:
    """Tokens with identifiers, numbers and strings masked, and a digest of the unmasked ones; comments count for neither."""
    found = [(m.lastgroup, m.group()) for m in _MASK.finditer(text)]
    plain = "\0".join(v for k, v in found if k != "C")
    toks = [v if k == "O" or k == "I" and v in _ALL_WORDS else k for k, v in found if k != "C"]
    return toks, hashlib.sha256(plain.encode("utf-8", "replace")).hexdigest()


class _TokenCodes(dict):
    """64-bit code of each masked token, kept by a worker: words of the languages, single characters and masks."""

    def __missing__(self, tok: str) -> int:
        self[tok] = xxhash.xxh64_intdigest(tok.encode("utf-8", "replace"))
        return self[tok]


_TOKEN_CODES = _TokenCodes()


def shingle_set(toks: list[str]) -> np.ndarray:
    """Sorted 32-bit hashes of the runs of SHINGLE tokens; a shorter text is one run."""
    codes = np.array([_TOKEN_CODES[t] for t in toks], np.uint64)
    n = max(1, len(codes) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = codes[k : k + n]
        h[: len(part)] = (h[: len(part)] ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32))


_PERMS = np.random.default_rng(11).integers(1, 2**62, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One hash a band of ROWS MinHash values."""
    x = shingles.astype(np.int64).view(np.uint64)[None, :]
    h = (x ^ (x >> np.uint64(31))) * _PERMS[0][:, None] + _PERMS[1][:, None]
    h ^= h >> np.uint64(29)
    least = (h * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1).reshape(BANDS, ROWS)
    return [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in least]


FEATURES = "path string, repo string, lang string, marks array<string>, code_id string, set_id string, shingles array<int>, literal double"


def features(files: DataFrame) -> DataFrame:
    """One row a current file: what marks it, its masked shingles, and ids of its token stream and shingle set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, repo, text in zip(b["path"], b["repo"], b["content"], strict=True):
                marks, code, set_id, sh, literal = path_marks(path), None, None, None, None
                if text is not None:
                    marks |= text_marks(text)
                    toks, code = masked(text)
                    sh = shingle_set(toks)
                    set_id = hashlib.sha256(sh.tobytes()).hexdigest()[:32]
                    n = Counter(toks)
                    literal = (n["N"] + n["S"] + n[","] + n["-"]) / max(1, len(toks))
                rows.append((path, repo, language_of(path, text), sorted(marks), code, set_id, sh, literal))
            yield pd.DataFrame(rows, columns=["path", "repo", "lang", "marks", "code_id", "set_id", "shingles", "literal"])

    cur = current_rows(files, "path", ["generation", "repo", "content"])
    return cur.select("path", "repo", "content").mapInPandas(run, FEATURES)


def _common(sets: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in ``left`` with those in ``right``."""
    flat, size = sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy())
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(size)), size), count[code] > 1
    row, (names, code) = row[shared], np.unique(code[shared], return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(names), 8_192):
        here = (code >= lo) & (code < lo + 8_192)
        m = np.zeros((len(size), min(8_192, len(names) - lo)), np.float32)
        m[row[here], code[here] - lo] = 1
        out += m[left] @ m[right].T
    return out


class _Spanning:
    """Links that join similar sets, over all the groups that one task sees.

    A group is one block of sets, or two of which the first has side 0. Pairs
    are compared only where their ends are in different components so far, so a
    group whose sets earlier groups have joined costs nothing, and no link
    between components is lost.
    """

    def __init__(self):
        self.root: dict[str, str] = {}

    def find(self, i: str) -> str:
        root = self.root
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    def links(self, group: pa.RecordBatch) -> list[tuple[str, str]]:
        ids, side = group.column("set_id").to_pylist(), group.column("side").to_numpy(zero_copy_only=False)
        roots = [self.find(i) for i in ids]
        if len(set(roots)) == 1:
            return []
        sets = group.column("shingles")
        size = np.diff(sets.offsets.to_numpy())
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(ids)),) * 2
        both = _common(sets, left, right)
        i, j = np.nonzero(both >= SIMILARITY * (size[left][:, None] + size[right][None, :] - both))
        out = []
        for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
            x, y = self.find(ids[a]), self.find(ids[b])
            if x != y:
                self.root[x] = y
                out.append((ids[a], ids[b]))
        return out


def _spanning_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of sorted rows (group..., side, set_id, shingles); a group ends where the next begins."""
    task, held, key = _Spanning(), [], None
    whole = lambda parts: parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["a", "b"])
    for b in batches:
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-3]], axis=1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        out: list[tuple[str, str]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo].tolist() != key:
                out += task.links(whole(held))
                held = []
            held.append(b.slice(lo, hi - lo))
            key = keys[lo].tolist()
        yield rows(out)
    if held:
        yield rows(task.links(whole(held)))


def family_links(sets: DataFrame) -> DataFrame:
    """Verified spanning links (a, b) between distinct shingle sets of similarity SIMILARITY or more.

    Sets meet in MinHash bands. A bucket is cut by size class (sets more than
    1/SIMILARITY apart in size cannot be similar) and hash into blocks of about
    BLOCK sets; each pair of blocks of the same or neighbouring classes is one
    group, so the largest group is two blocks whatever a bucket holds.
    """

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, key, len(sh)) for s, sh in zip(b["set_id"], b["shingles"], strict=True) for k, key in enumerate(band_keys(np.asarray(sh)))]
            yield pd.DataFrame(rows, columns=["set_id", "band", "key", "size"])

    step = -np.log(SIMILARITY)
    keyed = sets.mapInPandas(bands, "set_id string, band int, key bigint, size int").withColumn("cls", F.floor(F.log("size") / step).cast("int"))
    sizes = keyed.groupBy("band", "key", "cls").count().withColumn("k", F.ceil(F.col("count") / BLOCK).cast("int"))
    blocks = sizes.groupBy("band", "key").agg(F.map_from_entries(F.collect_list(F.struct("cls", "k"))).alias("ks"), F.sum("count").alias("n")).where("n > 1").drop("n")
    placed = keyed.join(blocks, ["band", "key"])
    own = F.coalesce(F.col("ks")[F.col("cls")], F.lit(1))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("set_id", F.lit(3)), own).cast("int"))
    up, down = F.col("ks")[F.col("cls") + 1], F.col("ks")[F.col("cls") - 1]
    to = lambda n: F.when(n.isNotNull(), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(to(own), lambda j: F.struct(F.col("cls").alias("c1"), F.least(j, F.col("blk")).alias("b1"), F.col("cls").alias("c2"), F.greatest(j, F.col("blk")).alias("b2"), F.when(F.col("blk") > j, 1).otherwise(0).alias("side")))
    above = F.transform(to(up), lambda j: F.struct(F.col("cls").alias("c1"), F.col("blk").alias("b1"), (F.col("cls") + 1).alias("c2"), j.alias("b2"), F.lit(0).alias("side")))
    below = F.transform(to(down), lambda j: F.struct((F.col("cls") - 1).alias("c1"), j.alias("b1"), F.col("cls").alias("c2"), F.col("blk").alias("b2"), F.lit(1).alias("side")))
    tasks = placed.select("set_id", "band", "key", F.explode(F.concat(same, above, below)).alias("t")).select("set_id", "band", "key", "t.*")
    group = ["band", "key", "c1", "b1", "c2", "b2"]
    # groups of one set, and of two blocks of which one is empty, hold no pair; equal groups of several bands are compared once
    tasks = tasks.withColumn("member", F.xxhash64("set_id", "side"))
    kept = tasks.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("member").cast("decimal(38,0)")).alias("same")).where("n > 1")
    kept = kept.groupBy("n", "same").agg(F.min(F.struct(*group)).alias("g")).select("g.*")
    work = tasks.join(kept, group).select("set_id", *group, "side").join(sets.select("set_id", "shingles"), "set_id")
    # one sorted stream a task: most groups are small, and a call for each would cost more than its comparisons
    ordered = work.select(*group, "side", "set_id", "shingles").repartition(*group).sortWithinPartitions(*group, "side", "set_id")
    return ordered.mapInArrow(_spanning_rows, "a string, b string").distinct()


def _beyond_chance(marked: Column, n: Column, rate: float) -> Column:
    """Whether more than half of ``n`` are marked, and so many by chance at the corpus's ``rate`` less often than CHANCE (Chernoff's bound)."""
    x, p = marked / n, min(max(rate, 1e-12), 1 - 1e-12)
    apart = x * F.log(x / F.lit(p)) + F.when(x < 1, (1 - x) * F.log((1 - x) / F.lit(1 - p))).otherwise(0.0)
    return F.coalesce((2 * marked > n) & (x > p) & (n * apart > -math.log(CHANCE)), F.lit(False))


def judged(files: DataFrame) -> DataFrame:
    """(path, repo, lang, family, family_files, family_repos, kinds): every current file with its family and why it is not hand-written.

    Files with text fall into families of similar masked shingles. Within a
    family, evidence is weighed: a family of literals only holds data blobs;
    marks of a file (a tool's or upstream's head comment, the folder, the name,
    dense lines, literal bulk) stand for the file and for every member of its
    family with the same token stream, in the repository for generation and
    minifying and across repositories for vendoring. Where more than half of the
    distinct token streams of a family are so marked, and more than chance would
    mark at the corpus's rate, the mark stands for its near members too: within one repository for generation and minifying, in
    the whole of a family that spans repositories for vendoring. Other families
    are hand-written but for their marked streams, however alike, since
    hand-written files share templates. Files without text are judged by path.

    ``kinds`` is empty for hand-written files. Null paths are dropped; an empty
    text is a family of its own kind; repeated rows count once.
    """
    told = cut(features(files))
    with_text = told.where("set_id is not null")
    sets = cut(with_text.groupBy("set_id").agg(F.min("shingles").alias("shingles")))
    families = connected_components(sets.select(F.col("set_id").alias("id")), cut(family_links(sets))).select(F.col("id").alias("set_id"), F.col("component").alias("family"))
    placed = cut(with_text.drop("shingles").join(families, "set_id"))
    family = placed.groupBy("family").agg(F.count("*").alias("family_files"), F.count_distinct("repo").alias("family_repos"), F.min("literal").alias("family_literal"))
    has = lambda k: F.array_contains("marks", k)
    copies = placed.groupBy("family", "code_id").agg(F.max(has("vendored")).alias("vendored"), F.max(has("blob")).alias("blob"))
    local = placed.groupBy("family", "code_id", "repo").agg(F.max(has("generated")).alias("generated"), F.max(has("minified")).alias("minified"))
    rate = {k: (df.agg(F.avg(F.col(k).cast("int"))).first()[0] or 0.0) for df, k in ((copies, "vendored"), (local, "generated"), (local, "minified"))}
    most = lambda k: _beyond_chance(F.count_if(k), F.count("*"), rate[k]).alias(f"near_{k}")
    across = copies.groupBy("family").agg(most("vendored")).join(family, "family").withColumn("near_vendored", F.col("near_vendored") & (F.col("family_repos") > 1))
    local = local.join(local.groupBy("family", F.col("repo").alias("near")).agg(most("generated"), most("minified")), "family").where(F.col("repo").eqNullSafe(F.col("near"))).drop("near")
    known = placed.alias("p").join(copies, ["family", "code_id"]).join(across, "family")
    known = known.join(local.withColumnRenamed("repo", "r"), ["family", "code_id"]).where(F.col("p.repo").eqNullSafe(F.col("r")))
    told_or_near = lambda k: F.when(F.col(k) | F.col(f"near_{k}"), F.lit(k))
    kinds = F.array_compact(F.array(
        told_or_near("generated"), told_or_near("minified"), told_or_near("vendored"),
        F.when(F.col("blob") | (F.col("family_literal") >= 0.95), F.lit("blob")),
    ))
    out = known.select("path", "p.repo", "lang", "family", "family_files", "family_repos", kinds.alias("kinds"))
    bare = told.where("set_id is null").select("path", "repo", "lang", F.lit(None).cast("string").alias("family"), F.lit(None).cast("bigint").alias("family_files"), F.lit(None).cast("bigint").alias("family_repos"), F.col("marks").alias("kinds"))
    return out.unionByName(bare)


def not_hand_written(files: DataFrame) -> DataFrame:
    return judged(files).where(F.size("kinds") > 0).select("path")


def family_report(files: DataFrame) -> DataFrame:
    """(family, n_files, n_repos, n_generated, n_minified, n_vendored, n_blob) of every family of two files or more."""
    each = [F.count_if(F.array_contains("kinds", k)).alias(f"n_{k}") for k in ("generated", "minified", "vendored", "blob")]
    return judged(files).where("family is not null").groupBy("family").agg(F.count("*").alias("n_files"), F.count_distinct("repo").alias("n_repos"), *each).where("n_files > 1")
