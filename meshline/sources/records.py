"""Saved records: feedback notes with front matter, managed source facts, worktree lists, table compaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_BYTES = 2 << 20
RECORD = "path string, event_id string, created string, contributor string, outcome string, question string, answer string, source_nodes array<string>, digest string"
_FIELD = re.compile(r"^(\w+):\s*(.*)$")


def parse_note(path: str, text: str) -> tuple:
    """Front matter of plain ``key: value`` lines, ``source_nodes`` as a bracketed or dashed list, then the answer."""
    m = re.match(r"---\n(.*?)\n---\n?(.*)\Z", text, re.S)
    if not m:
        raise ValueError(f"{path}: no front matter")
    head: dict = {}
    last = None
    for line in m.group(1).split("\n"):
        f = _FIELD.match(line)
        if f:
            last, value = f.group(1), f.group(2).strip()
            head[last] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else value.strip("\"'")
        elif last and line.strip().startswith("- "):
            head[last] = [*(head[last] or []), line.strip()[2:].strip("\"' ")] if isinstance(head.get(last), list) or not head.get(last) else head[last]
    if not head.get("event_id"):
        raise ValueError(f"{path}: no event id")
    if head.get("outcome") not in (None, "", "useful", "dead_end", "corrected"):
        raise ValueError(f"{path}: unknown outcome {head['outcome']!r}")
    nodes = head.get("source_nodes") or []
    return path, head["event_id"], head.get("created"), head.get("contributor"), head.get("outcome") or None, head.get("question"), m.group(2).strip(), nodes if isinstance(nodes, list) else [nodes]


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """One row an event from all notes below ``root``; copies of an event count once, differing ones are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path", "length", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for p, n, c in zip(b["path"], b["length"], b["content"], strict=True):
                if n > NOTE_BYTES:
                    raise ValueError(f"{p}: {n} bytes; the bound is {NOTE_BYTES}")
                r = parse_note(p, bytes(c).decode())
                rows.append((*r, hashlib.sha256(repr(r[1:]).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    notes = files.mapInPandas(run, RECORD)
    rest = [c for c in notes.columns if c != "event_id"]
    one = notes.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("r"), F.count_distinct("digest").alias("n"))
    sure = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("an event with differing copies: "), "event_id")).cast("string")).otherwise(F.col("event_id"))
    return one.select(sure.alias("event_id"), *[F.col(f"r.{c}").alias(c) for c in rest])


def save_facts(facts: DataFrame, root: str) -> None:
    """Facts of managed sources, partitioned by the digest of their source; a source saved again replaces its own."""
    facts.withColumn("source_id", F.sha2("path", 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(root)


def worktrees(raw: str) -> list[tuple[str, str | None]]:
    """(path, branch) of a NUL-separated porcelain list of worktrees."""
    out: list[tuple[str, str | None]] = []
    for item in raw.split("\0"):
        if item.startswith("worktree "):
            out.append((item[9:], None))
        elif item.startswith("branch ") and out:
            out[-1] = (out[-1][0], item[7:].removeprefix("refs/heads/"))
    return out


def compact(spark: SparkSession, source: str, target: str, bytes_per_file: int = 128 << 20) -> dict[str, int]:
    """Rewrite a table into fewer, larger files and report both sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    size = lambda p: files.load(p).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    before = size(source)
    spark.read.parquet(source).repartition(max(1, -(-before["b"] // bytes_per_file))).write.mode("overwrite").parquet(target)
    after = size(target)
    return {"files_before": before["n"], "bytes_before": before["b"], "files_after": after["n"], "bytes_after": after["b"]}
