"""Connected components of links: by alternating large and small stars, in DataFrames alone, or, of few links, by numpy in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _with_least(links: DataFrame) -> DataFrame:
    m = _least(links).select(*apart("a"), "m")
    return links.select("a", "b", *apart("a")).join(m, "__k0").select("a", "b", F.least("a", "m").alias("m"))


def _stars(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    t = _with_least(down)
    small = t.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(t.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def hooked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node but its component's least, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def components(links: DataFrame, max_rounds: int = 60, max_local: int = 1_000_000) -> DataFrame:
    """links(a long, b long) to (a, b): each linked node but its component's least, and that least node.

    At most max_local links (16 bytes each, counted before) are joined by one task. More of them take rounds, each a fixed number of shuffles of at most two rows
    a link, cut by a checkpoint; a count and a checksum alone reach the driver.
    """
    cur = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if cur.count() <= max_local:

        def run(batches):
            got = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            a, b = hooked(got["a"].to_numpy(), got["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return checkpointed(cur.coalesce(1).mapInArrow(run, "a long, b long"))
    seen = None
    for _ in range(max_rounds):
        sign = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            return cur
        seen, cur = sign, checkpointed(_stars(cur))
    raise RuntimeError("components did not settle")
