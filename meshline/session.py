"""Session helpers: lineage cuts in the shared checkpoint folder, table access, sizing."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster's own setting (``spark.checkpoint.dir``) always wins. Only a
    local master without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="meshline-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage.

    A checkpoint keeps the size estimate and the constraints of its plan. In a
    loop those of a round are products of those of the round before: the digits
    of the estimate double, and after some twenty rounds the driver does nothing
    but multiply them. So the rows alone are taken.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def positions(df: DataFrame, column: str, name: str) -> DataFrame:
    """(``column``, ``name``): the rank from 0 of each row of a one-column table of distinct values.

    Rows are sorted by ranges; a row's place is its place in its range and the
    sizes of the ranges before, of which there is one number a partition.
    """
    ordered = cut(df.select(column).repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_n").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(before), "_part").select(column, (F.col("_n") - F.col("_first") + F.col("_before")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, per_bucket: int = 100_000, least: int = 12) -> int:
    """Number of grouped-map buckets so that one bucket holds about ``per_bucket`` rows at any scale."""
    return max(least, math.ceil(rows / per_bucket))
