"""Checkpoints, global ranks and prefix sums that no single task holds."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, in the cluster's shared checkpoint folder (a temporary one where none is set)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with 0-based ranks: a range sort, then each partition's first rank from the counts of the partitions alone."""
    rows = cut(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, at = {}, 0
    for p in sorted(counts):
        first[p], at = at, at + counts[p]
    if not first:
        return rows.select(*df.columns, F.lit(0).cast("long").alias(name))
    offset = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(first) + 1)])  # folded into one constant, read by place
    return rows.withColumn(name, F.get(offset, part.cast("int")) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def prefix_sum(df: DataFrame, key: str, value: str, name: str, n: int | None = None, block: int = 1 << 16, window: int = 1 << 20) -> DataFrame:
    """df, one row a key of 0.., with the sum of value over smaller keys: within blocks of keys, plus the blocks' own running sum.

    With n, the number of keys, the blocks' sums are taken in blocks again where they are more than a window should hold.
    """
    b = F.floor(F.col(key) / block).cast("long").alias("__b")
    blocks = df.groupBy(b).agg(F.sum(value).alias("__s"))
    if n is not None and n > block * window:
        first = prefix_sum(blocks.select(F.col("__b").alias("__k"), F.col("__s").alias("__v")), "__k", "__v", "__n", -(-n // block), block, window).select(F.col("__k").alias("__b"), F.col("__n").alias("__f"))
    else:
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65,536 keys
        first = blocks.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__f"))
    own = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__b", b).join(first, "__b").withColumn(name, F.col("__f") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__b", "__f")
