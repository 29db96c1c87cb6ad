"""Directory scan: files with their digest, ignore rules, size caps; change stamps."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_BYTES, DOCUMENT_BYTES = 4 << 20, 32 << 20
# Folders of generated content that a scan leaves out unless asked.
SKIPPED = ("node_modules", "target", "dist", "build", "out", "__pycache__", ".venv", "venv", ".next", ".cache", "coverage", "vendor", ".tox", ".mypy_cache")
DOCUMENTS = ("md", "markdown", "mdx", "txt", "rst", "html", "htm", "yaml", "yml", "pdf", "docx", "xlsx")


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether the last matching rule of a gitignore-like list leaves the path out; ``!`` takes it back."""
    out = False
    for rule in patterns:
        p = rule.strip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.lstrip("!")
        name = p.strip("/")
        parts = path.split("/")
        heads = ["/".join(parts[:k]) for k in range(1, len(parts) + (not p.endswith("/")))]
        hit = any(fnmatch.fnmatchcase(h, name) for h in heads) if "/" in name or p.startswith("/") else any(fnmatch.fnmatchcase(h.rsplit("/", 1)[-1], name) for h in heads)
        if hit:
            out = not keep
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, include_generated: bool = False) -> DataFrame:
    """(path, length, modified, hash, content): files below ``root``; what is above its cap keeps its hash only."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", "^.*?" + base.replace(".", "\\.") + "/", "")
    out = files.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), "content")
    parts = F.split("path", "/")
    out = out.where(~F.exists(parts, lambda p: p.isin(".git")))
    if not include_generated:
        out = out.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    if patterns:
        rule = F.udf(lambda p: not ignored(p, patterns), "boolean")
        out = out.where(rule("path"))
    ext = F.lower(F.element_at(F.split("path", "\\."), -1))
    cap = F.when(ext.isin(*DOCUMENTS), DOCUMENT_BYTES).otherwise(CODE_BYTES)
    return out.withColumn("content", F.when(F.col("length") <= cap, F.col("content")))
