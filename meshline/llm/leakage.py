"""Evaluation texts inside a training corpus: latent semantic retrieval of passages, then exact and fuzzy checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshline.llm.lookalike import one_form
from meshline.session import cut

RUN = 12
RANK = 64
EXTRA = 16
FEATURES = 1 << 13
WORD_BITS = KEY_BITS = 1 << 22
EXACT_COSINE = 0.95
COSINE = 0.8
LCS_SHARE = 0.75
ANSWER_SPAN = 2
EXACT_BANDS = (2, 32)
BANDS = (32, 15)
FURTHEST = 20
WINDOW_BLOCK = 4_096
SALTS = 8
INDEX_BYTES = 32 << 20
INDEX_ROW_BYTES = 160
KEEP_WORDS = 1_000_000
SEED = 7
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text's one form, without case."""
    return _WORD.findall(one_form(text).casefold()) if text else []


class _Codes(dict):
    """64-bit code of each word, kept by a worker for later rows."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), SEED)
        code = (code - (1 << 64) if code >= 1 << 63 else code) or 1
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = code
        return code


_CODES = _Codes()


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ids array<bigint>): the words of each text as 64-bit codes; rows with a null key or text are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [list(map(_CODES.__getitem__, words(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[key, "ids"])

    kept = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias(key), text)
    return kept.mapInArrow(run, f"{key} bigint, ids array<bigint>")


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits that the values of a bigint column hit, modulo ``bits``: ``bits / 64`` words whatever the number of rows."""
    at = values.select(F.expr(f"{column} & {bits - 1}L").alias("at")).where("at is not null")
    words_ = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("m"))
    out = np.zeros(bits // 64, np.int64)
    for r in words_.collect():
        out[r["w"]] = r["m"]
    return out.view(np.uint64)


def _hit(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class _Batch:
    """The texts of one batch as one array, with the places where windows of RUN words stand."""

    def __init__(self, ids: pa.ListArray):
        self.flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = ids.offsets.to_numpy()
        self.size = np.diff(ends)
        self.doc = np.repeat(np.arange(len(ids)), self.size)
        self.pos = np.arange(len(self.flat)) - (ends[:-1] - ends[0])[self.doc]
        self.left = self.size[self.doc] - self.pos

    def side_by_side(self) -> np.ndarray:
        """Starts of windows side by side, the last one of a text flush with its end."""
        return np.flatnonzero((self.left >= RUN) & ((self.pos % RUN == 0) | (self.left == RUN)))

    def dense(self, known: np.ndarray, least: int) -> np.ndarray:
        """Starts of all windows with at least ``least`` known words."""
        total = np.concatenate([[0], np.cumsum(known)])
        starts = np.flatnonzero(self.left >= RUN)
        return starts[total[starts + RUN] - total[starts] >= least]

    def rows(self, starts: np.ndarray) -> np.ndarray:
        return self.flat[starts[:, None] + np.arange(RUN)]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _features(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Hashed term of each known word, FEATURES for all others."""
    return np.where(known, (codes >> 23) & (FEATURES - 1), FEATURES).astype(np.int32)


def _summed(encoded: DataFrame, fold, columns: int) -> np.ndarray:
    """Sum over all rows of a matrix with FEATURES rows; ``fold(batch, total)`` adds a batch.

    A task sends one partial, in blocks; blocks are summed on the executors in
    two levels, and the driver receives one matrix of fixed size.
    """
    rows = max(1, (1 << 20) // (8 * columns))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, columns))
        for b in batches:
            fold(_Batch(b.column(1)), total)
        at = [i for i in range(0, FEATURES, rows) if total[i : i + rows].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : min(FEATURES, i + rows)].tobytes() for i in at], pa.binary())], names=["block", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    level = encoded.mapInArrow(part, "block int, m binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32)))
    level = level.groupBy("block", "g").applyInPandas(lambda pdf: add(pdf), "block int, m binary")
    level = level.groupBy("block").applyInPandas(lambda pdf: add(pdf), "block int, m binary")
    out = np.zeros((FEATURES, columns))
    for r in level.collect():
        got = np.frombuffer(r["m"]).reshape(-1, columns)
        out[r["block"] : r["block"] + len(got)] = got
    return out


def _coordinates(space: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Rows of latent coordinates. Words are added one after another, so equal windows have equal bits on every machine."""
    out = space[feats[:, 0]].copy()
    for k in range(1, feats.shape[1]):
        out += space[feats[:, k]]
    return out


def latent_space(encoded: DataFrame, word_bits: np.ndarray) -> np.ndarray:
    """Weighted and rotated right singular vectors, (FEATURES + 1) x RANK: what each hashed term adds to a passage.

    Terms are the words that the evaluation set knows, hashed to FEATURES
    columns, so no dictionary exists and all sizes are fixed. Randomised SVD of
    the TF-IDF matrix of all passages (windows of RUN words side by side): a
    pass for the document frequencies, one for ``A'A W`` with a random ``W``,
    its QR, one for ``A'A Q``, and the small eigenproblem ``Q'A'AQ``. A fixed
    rotation makes the signs of the coordinates a code of random hyperplanes.
    The last row, of unknown words, is zero.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(word_bits)

    def df(b: _Batch, total: np.ndarray) -> None:
        feats = _features(b.flat, _hit(shared.value, b.flat))
        total[:, 0] += np.bincount(np.unique(b.doc * (FEATURES + 1) + feats) % (FEATURES + 1), minlength=FEATURES + 1)

    n_docs = encoded.count()
    idf = np.append(np.log((1 + n_docs) / (1 + _summed(encoded, df, 1)[:, 0])) + 1, 0)

    def gram(basis: np.ndarray):
        basis = np.vstack([basis, np.zeros(basis.shape[1])]) * idf[:, None]

        def fold(b: _Batch, total: np.ndarray) -> None:
            starts = b.side_by_side()
            feats = _features(b.flat, _hit(shared.value, b.flat))
            for lo in range(0, len(starts), WINDOW_BLOCK):
                win = feats[starts[lo : lo + WINDOW_BLOCK, None] + np.arange(RUN)]
                win = win[(win < FEATURES).any(axis=1)]
                if not len(win):
                    continue
                y = _coordinates(basis, win)
                at, row = win.ravel(), np.repeat(np.arange(len(win)), RUN)
                order = np.argsort(at, kind="stable")
                at, row = at[order], row[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                total[at[first]] += np.add.reduceat(y[row], first, axis=0) * idf[at[first], None]

        return fold

    width, rng = RANK + EXTRA, np.random.default_rng(SEED)
    q, _ = np.linalg.qr(_summed(encoded, gram(rng.standard_normal((FEATURES, width))), width))
    _, vectors = np.linalg.eigh(q.T @ _summed(encoded, gram(q), width))
    turn, _ = np.linalg.qr(rng.standard_normal((RANK, RANK)))
    basis = q @ vectors[:, ::-1][:, :RANK] @ turn
    return (np.vstack([basis, np.zeros(RANK)]) * idf[:, None]).astype(np.float32)


def _sign_code(coordinates: np.ndarray) -> np.ndarray:
    """The signs of the RANK coordinates as one 64-bit code."""
    return np.packbits(coordinates > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _masks(bands: tuple[int, int]) -> np.ndarray:
    """Bits that each band reads: side by side where the code has enough of them, else drawn at random."""
    n, bits = bands
    rng = np.random.default_rng(SEED)
    picks = np.arange(RANK).reshape(n, bits) if n * bits == RANK else [rng.choice(RANK, bits, replace=False) for _ in range(n)]
    return np.array([sum(1 << int(k) for k in p) for p in picks], np.uint64)


def _band_keys(codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """One key per code and band, mixed so that its low bits are even."""
    x = (codes[:, None] & masks) ^ (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


INDEX = "owner bigint, code bigint, words array<bigint>, keys array<struct<key: bigint, band: int>>"


def _indexed(encoded: DataFrame, owner: str, space, word_bits, bands: tuple[int, int], least: int, key_bits=None) -> DataFrame:
    """(``owner``, code, words, key, band): a row for each band of each window with ``least`` known words or more.

    With ``key_bits`` only keys that the other side has are kept. ``space``,
    ``word_bits`` and ``key_bits`` are broadcast arrays of fixed size.
    """
    masks = _masks(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            b = _Batch(rows.column(1))
            known = _hit(word_bits.value, b.flat)
            starts, feats = b.dense(known, least), _features(b.flat, known)
            owners = rows.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(starts), WINDOW_BLOCK):
                at = starts[lo : lo + WINDOW_BLOCK]
                code = _sign_code(_coordinates(space.value, feats[at[:, None] + np.arange(RUN)]))
                keys = _band_keys(code, masks)
                met = np.ones(keys.shape, bool) if key_bits is None else _hit(key_bits.value, keys)
                n = met.sum(axis=1)
                some = np.flatnonzero(n)
                columns = [pa.array(owners[b.doc[at[some]]]), pa.array(code.view(np.int64)[some]), _lists(b.rows(at[some]).ravel(), np.arange(0, RUN * len(some) + 1, RUN)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])), pa.int32()), pa.StructArray.from_arrays([pa.array(keys[met]), pa.array(np.nonzero(met)[1], pa.int32())], ["key", "band"]))]
                yield pa.RecordBatch.from_arrays(columns, names=[owner, "code", "words", "keys"])

    return encoded.mapInArrow(run, INDEX.replace("owner", owner)).select(owner, "code", "words", F.explode("keys").alias("k")).select(owner, "code", "words", "k.*")


def _lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of ``a`` and ``b``."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        step = np.where(b == a[:, i : i + 1], row[:, :-1] + 1, 0)
        row[:, 1:] = np.maximum.accumulate(np.maximum(step, row[:, 1:]), axis=1)
    return row[:, -1]


def _verified(pairs: DataFrame, space, word_bits, cosine: float, share: float) -> DataFrame:
    """(doc_id, window, lcs_share) of the candidates whose latent cosine and common subsequence suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, WINDOW_BLOCK):
                part = rows.slice(lo, WINDOW_BLOCK)
                a, b = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, RUN) for i in (2, 3))
                x, y = (_coordinates(space.value, _features(w, _hit(word_bits.value, w))).astype(np.float64) for w in (a, b))
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                near = np.flatnonzero((x * y).sum(axis=1) >= cosine * size * (1 - 1e-6))
                lcs = _lcs(a[near], b[near]) / RUN
                ok = near[lcs >= share]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), part.column(1).take(pa.array(ok)), pa.array(lcs[lcs >= share], pa.float64())], names=["doc_id", "window", "lcs_share"])

    return pairs.mapInArrow(run, "doc_id bigint, window bigint, lcs_share double")


def _search(docs: DataFrame, items: DataFrame, bands: tuple[int, int], cosine: float, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, encoded documents, encoded items); hits are (doc_id, item_id, lcs_share), the best share of each pair."""
    sc = docs.sparkSession.sparkContext
    wanted = cut(encode(items.select("item_id", "text").distinct(), "item_id", "text"))
    encoded = cut(encode(docs, "doc_id", "text"))
    word_bits = bitmap(wanted.select(F.explode("ids").alias("v")), "v", WORD_BITS)
    space = sc.broadcast(latent_space(encoded, word_bits))
    known = sc.broadcast(word_bits)
    windows = cut(_indexed(wanted, "item_id", space, known, bands, RUN).withColumn("window", F.xxhash64("words")))
    owners = windows.select("window", "item_id").distinct()
    index = cut(windows.select("window", "key", "band", F.col("code").alias("item_code"), F.col("words").alias("item_words")).dropDuplicates(["window", "key"]))
    key_bits = sc.broadcast(bitmap(index, "key", KEY_BITS))
    passages = _indexed(encoded, "doc_id", space, known, bands, int(np.ceil(share * RUN)), key_bits).drop("band")
    if index.count() * INDEX_ROW_BYTES <= INDEX_BYTES:
        met = passages.join(F.broadcast(index), "key")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = passages.withColumn("salt", F.pmod(F.xxhash64("doc_id", "words"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    differ = F.col("code").bitwiseXOR(F.col("item_code"))
    # a pair that meets in several bands counts in the first one
    first = [(F.col("band") <= k) | (differ.bitwiseAND(F.lit(m)) != 0) for k, m in enumerate(_masks(bands)[:-1].view(np.int64).tolist())]
    met = met.where((F.bit_count(differ) <= FURTHEST) & reduce(Column.__and__, first))
    hits = _verified(met.select("doc_id", "window", "words", "item_words"), space, known, cosine, share)
    best = hits.groupBy("doc_id", "window").agg(F.max("lcs_share").alias("lcs_share"))
    return best.join(owners, "window").groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share")), encoded, wanted


def exact_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold RUN words of the item's text in a row.

    Every window of RUN words of an item is indexed by the signs of its latent
    coordinates, in bands. A document's windows of known words that meet one in
    a band are candidates; their cosine and then the longest common subsequence,
    which must be the whole window, decide. Equal windows have equal codes, so
    none is lost. What is broadcast has a fixed size, but for the index, which is
    joined with salt where it exceeds INDEX_BYTES.

    Null documents, documents and items of fewer than RUN words and empty tables
    give no row; repeated rows count once.
    """
    return _search(docs, items, EXACT_BANDS, EXACT_COSINE, 1.0)[0].select("doc_id", "item_id")


def _contains(ids: np.ndarray, want: np.ndarray | None) -> bool:
    """Whether the words of an answer follow in order within ANSWER_SPAN times their number of words."""
    if want is None or not len(want):
        return False
    places = [np.flatnonzero(ids == w) for w in want]
    if not all(map(len, places)):
        return False
    for start in places[0]:
        at = start
        for p in places[1:]:
            k = np.searchsorted(p, at, side="right")
            if k == len(p) or p[k] - start >= ANSWER_SPAN * len(want):
                break
            at = p[k]
        else:
            return True
    return False


def paraphrases(docs: DataFrame, items: DataFrame, cosine: float = COSINE, share: float = LCS_SHARE) -> DataFrame:
    """(doc_id, item_id, lcs_share, has_answer): documents with a passage that follows an item's words in order.

    Candidates meet in bands of fewer bits than in ``exact_leaks``; each one at
    or above ``cosine`` has its longest common subsequence with the item's
    window taken, which must reach ``share`` of the window. ``has_answer`` tells
    whether the words of one of the item's answers follow in order, at most
    ANSWER_SPAN times as many words apart, anywhere in the document. The bands may miss a passage (recall is measured in the
    tests); exact leaks are always among the rows, with a share of 1. Null
    cases are those of ``exact_leaks``; a null or empty answer is never held.
    """
    hits, encoded, _ = _search(docs, items, BANDS, cosine, share)
    hits = cut(hits)
    answers = encode(items.select("item_id", "answer").distinct(), "item_id", "answer").withColumnRenamed("ids", "answer_ids")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [_contains(np.asarray(x), w) for x, w in zip(b["ids"], b["answer_ids"], strict=True)]
            yield b[["doc_id", "item_id", "lcs_share"]].assign(held=held)

    asked = encoded.join(hits, "doc_id").join(answers, "item_id", "left").select("doc_id", "item_id", "lcs_share", "ids", "answer_ids")
    held = asked.mapInPandas(check, "doc_id bigint, item_id bigint, lcs_share double, held boolean")
    return held.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("held").alias("has_answer"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, item_id, n_docs): the leaked items with the number of documents that hold them."""
    return exact_leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items.select("item_id", "suite").distinct(), "item_id").select("suite", "item_id", "n_docs")
