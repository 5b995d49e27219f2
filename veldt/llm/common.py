"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
#: White space of all word and line rules: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z become lower case, all else stays.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words at which a worker's memo is emptied: some 20 bytes each, beside what is remembered of them.
MEMO_MAX = 500_000


class Memo:
    """Words numbered in the order in which they came. Arrow holds them and looks them up, so that Python sees new ones alone."""

    def __init__(self) -> None:
        self.known = pa.array([], pa.string())

    def __len__(self) -> int:
        return len(self.known)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The numbers of distinct words, and which of them are new."""
        at = pc.index_in(words, value_set=self.known)
        if not at.null_count:
            return at.to_numpy(), []
        fresh = pc.is_null(at)
        new = words.filter(fresh)
        out = pc.fill_null(at, 0).to_numpy().copy()
        out[fresh.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, new])
        return out, new.to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters as they are; lower() itself where all is ASCII, as it is much faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python: Arrow batches are to have few rows. The option counts when a plan runs, so that it is only ever lowered."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some `most` bytes, or a row, so that what Python makes of one stays small beside long texts too."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)


def give_back() -> None:
    """Freed memory goes back to the system, as a worker stays for other stages, beside the JVM's heap; where the C library can't, it stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """df's batches through fn, which gives columns by the names of schema."""
    small_batches(df.sparkSession)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = fn(b)
            give_back()
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (cols[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_SCOPE: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut, by a Parquet table in the shared folder: smaller than a checkpoint, and read by columns. Within scratch() it is removed at the end."""
    spark = df.sparkSession
    at = "/".join([shared_folder(spark), spark.sparkContext.applicationId, *_SCOPE, uuid.uuid4().hex])
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What stored() writes inside is removed at the end; results that rest on it must have been written by then."""
    _SCOPE.append(f"scratch-{uuid.uuid4().hex}")
    at = "/".join([shared_folder(spark), spark.sparkContext.applicationId, *_SCOPE])
    try:
        yield
    finally:
        _SCOPE.pop()
        remove(spark, at)


def bounded(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """df, whose rows are a few numbers each, to be broadcast if they are max_rows or fewer; they are computed once, and counted."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(*cols: str) -> list[Column]:
    """Equal keys in another guise: a join on them is dealt anew instead of reusing a grouping's partitions, so that adaptive execution may split a hot key."""
    return [F.col(c).bitwiseXOR(F.lit(0x5DEECE66D)).alias(f"__k{i}") for i, c in enumerate(cols)]
