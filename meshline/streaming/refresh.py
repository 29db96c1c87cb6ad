"""Streaming refresh: files of rows arrive, each micro-batch becomes one atomic generation of the current table."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from meshline.session import checkpoint_dir
from meshline.tables import current_rows


class Generations:
    """Versioned directories under one root, each made current by a pointer file ``_pointers/N`` that is created once and never changed.

    A reader pins the highest pointer. ``publish`` writes its rows to a folder of
    its own name and then creates the next pointer; creation fails if the pointer
    exists, so of two writers with one baseline exactly one wins, and a crash
    before it leaves the earlier generation current. Nothing is written if the
    batch was already applied, so a replayed micro-batch is harmless.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{root}/_pointers"))

    def state(self) -> dict:
        known = [x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.root}/_pointers"))]
        last = max((int(n) for n in known if n.isdigit()), default=0)
        if not last:
            return {"generation": 0, "batch": -1, "folder": None}
        return json.loads(self.spark.read.text(f"{self.root}/_pointers/{last}").first()[0])

    def read(self, generation: int | None = None) -> DataFrame | None:
        now = self.state()
        if generation is not None and generation != now["generation"]:
            now = json.loads(self.spark.read.text(f"{self.root}/_pointers/{generation}").first()[0]) if generation else {"folder": None}
        return self.spark.read.parquet(f"{self.root}/{now['folder']}") if now["folder"] else None

    def publish(self, df: DataFrame, baseline: int, batch: int = -1) -> int:
        now = self.state()
        if batch >= 0 and now["batch"] >= batch:
            return now["generation"]
        stale = f"stale baseline {baseline}: the current generation is "
        if now["generation"] != baseline:
            raise RuntimeError(stale + str(now["generation"]))
        g = baseline + 1
        folder = f"gen={g}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        text = json.dumps({"generation": g, "batch": batch, "folder": folder}).encode()
        try:
            out = self.fs.create(self.path(f"{self.root}/_pointers/{g}"), False)
        except Py4JJavaError as e:
            self.fs.delete(self.path(f"{self.root}/{folder}"), True)
            raise RuntimeError(stale + str(self.state()["generation"])) from e
        out.write(bytearray(text))
        out.close()
        return g


def refresh(source: DataFrame, target: Generations, key: str, columns: list[str]) -> None:
    """Fold each micro-batch into the current table by the highest generation per key, until the source is drained."""

    def fold(batch: DataFrame, number: int) -> None:
        base = target.state()["generation"]
        fresh = batch.select(key, *columns)
        before = target.read(base) if base else None
        both = fresh if before is None else before.select(key, *columns).unionByName(fresh)
        target.publish(current_rows(both, key, columns), base, number)

    source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{target.root}/_stream").trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, d: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A file stream over one of the driver's tables, whether it is one file or a folder of parts."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/meshline-{name}-{uuid.uuid4().hex}"
