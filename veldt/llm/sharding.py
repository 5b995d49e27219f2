"""Sharding: weighted rendezvous hashing of stable record keys.

Every shard scores every key, score = -weight / ln(u) with u a hash of (key, shard) in (0, 1), and the highest score
holds the record. A shard's share follows its weight; a new shard takes rows only into itself, a removed one gives up
only its own. The law that holds is `key`: doc_id and the shards decide, nothing else.

Slots within a shard are numbered in two steps, so that no task holds a whole shard: rows are counted by (shard, partition that they lie in), a running
sum over that small table gives each pair's first slot, and rows are numbered within their pair, which holds a partition's rows at most, whatever
their keys and texts are.

Defined cases: a null doc_id is a key like any other; a null text has no bytes (size 16, crc 0); repeated doc_ids share a
shard and get slots of their own; equal texts go where their own keys say; texts of any length count whole; an empty table gives no rows; other columns are left
out, whatever their names. Ties of scores go to the smaller shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name, table

SHARDS = 40


def _score(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -weight / F.ln(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard that holds key. Ties (of 53-bit hashes) go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    all_shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return -F.array_max(F.transform(all_shards, lambda x: F.struct(_score(key, x["s"], x["w"]).alias("score"), (-x["s"]).alias("s"))))["s"]


def assign_shards(docs: DataFrame, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, grown_shard): grown_shard is the place with one more shard."""
    weights = weights or [1.0] * SHARDS
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """rows with slot: gapless from 0 within each shard."""
    at, n, first, part = (free_name(rows, x) for x in ("__at", "__n", "__first", "__part"))
    held = checkpointed(rows).withColumn(at, F.monotonically_increasing_id())  # the same again if a task is repeated: a checkpoint's partitions are fixed
    held = held.withColumn(part, F.shiftright(at, 33))
    counts = held.groupBy("shard", part).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    own = Window.partitionBy("shard", part).orderBy(at)
    numbered = held.withColumn(n, F.row_number().over(own) - 1)
    return numbered.join(start, ["shard", part]).select(*rows.columns, (F.col(first) + F.col(n)).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_slots(assign_shards(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
