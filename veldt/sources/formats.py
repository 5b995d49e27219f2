"""MatrixMarket, binary CRS and binary dense files: readers as Python data sources that split by rows, and writers.

Readers take paths that Python can open on every executor, and so do the writers of binary files: executors write their rows into the one file, each
batch at the place that its numbers give, so that a repeated task writes the same again; it is renamed when it is whole. Layouts: binary CRS has 5 int32 (endianness, version, base, symmetry,
data type) and 3 int64 (rows, columns, entries), then row pointers, columns and values; binary dense has 4 int32 (endianness, version, order,
data type) and 2 int64 (rows, columns), then the values.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.block_vector import BlockVector
from ..operators.matrix import SparseMatrix
from ..plans.dtypes import DType, MatrixTraits, Symmetry
from ..plans.util import cut, global_rank, prefix_sum

CRS_HEAD, DENSE_HEAD = 44, 32
SPLIT_ROWS = 1 << 20


# MatrixMarket
def parse_banner(line: str) -> tuple[str, str]:
    """(field, symmetry) of a coordinate file; what has no relation here is refused."""
    w = line.lower().split()
    if len(w) != 5 or w[:3] != ["%%matrixmarket", "matrix", "coordinate"]:
        raise ValueError("not a MatrixMarket coordinate matrix")
    if w[3] not in ("real", "complex", "integer"):
        raise ValueError(f"entries of kind {w[3]} are not supported")
    if w[4] not in ("general", "symmetric"):
        raise ValueError(f"symmetry {w[4]} is not supported")
    return w[3], w[4]


#: The letters of a MatrixMarket type code, fixed values of the format.
TYPECODE = ({"M": "matrix"}, {"C": "coordinate", "A": "array"}, {"R": "real", "C": "complex", "P": "pattern", "I": "integer"}, {"G": "general", "S": "symmetric", "H": "hermitian", "K": "skew-symmetric"})


def typecode_string(code: str) -> str:
    """MCRG to matrix coordinate real general."""
    if len(code) != 4 or any(c not in words for c, words in zip(code, TYPECODE, strict=True)):
        raise ValueError(f"{code} is no type code")
    return " ".join(words[c] for c, words in zip(code, TYPECODE, strict=True))


def typecode(banner: str) -> str:
    """The type code of a banner line."""
    w = banner.lower().split()
    found = ["".join(c for c, word in words.items() if word == x) for x, words in zip(w[1:], TYPECODE, strict=False)]
    if len(w) != 5 or w[0] != "%%matrixmarket" or not all(found):
        raise ValueError("not a MatrixMarket banner")
    return "".join(found)


def read_mm(spark: SparkSession, path: str, transpose: bool = False, want: DType | None = None) -> SparseMatrix:
    """Text lines are split by Spark's own reader, so any file system and size will do; symmetric files become general. Of several files the first by name has the head."""
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    head = [r["value"] for r in spark.read.text(files[0]).limit(10_000).collect()] if files else []
    kind, sym = parse_banner(head[0] if head else "")
    if want is not None and want.is_complex != (kind == "complex"):
        raise ValueError("real and complex entries don't turn into each other")
    size_line = next(x.strip() for x in head if x.strip() and not x.startswith("%"))
    m, n, _ = map(int, size_line.split())
    width = 4 if kind == "complex" else 3
    lines = text.select(F.trim("value").alias("t"))
    rows = lines.where(~F.col("t").startswith("%") & (F.col("t") != "") & (F.col("t") != size_line))
    if width == 3:  # a line equal to the size line is an entry if it comes again
        again = lines.where(F.col("t") == size_line).agg(F.count("*").alias("n")).where("n > 1")
        rows = rows.unionAll(again.select(F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).select(F.lit(size_line).alias("t")))
    rows = rows.select(F.split("t", r"\s+").alias("p"))
    val = F.struct(F.col("p")[2].cast("double").alias("re"), F.col("p")[3].cast("double").alias("im")) if width == 4 else F.col("p")[2].cast("double")
    df = rows.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), val.alias("v"))
    if sym == "symmetric":
        df = df.unionAll(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    a = SparseMatrix(df, m, n, MatrixTraits(dtype=want or (DType.Z if width == 4 else DType.D)))
    return a.transpose() if transpose else a


def write_mm(a: SparseMatrix, path: str, precision: int = 17, single: bool = False) -> None:
    """One text file a partition under path: the first holds the head, and all together are one file in order of names; single: one partition, for matrices that fit a
    task. Complex entries take two numbers. precision: digits of a number; 17 lose nothing, 3 are those of short listings."""
    pair = dict(a.df.dtypes)["v"].startswith("struct")
    kind, number = "complex" if pair else "real", f"%.{precision - 1}e"
    head = a.df.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general\n{a.nrows} {a.ncols} {a.nnz()}",)], "value string")
    values = [F.col("v.re"), F.col("v.im")] if pair else [F.col("v")]
    body = a.df.select(F.format_string(" ".join(["%d %d", *[number] * len(values)]), F.col("i") + 1, F.col("j") + 1, *values).alias("value"))
    out = head.coalesce(1).unionAll(body.coalesce(1) if single else body)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


# binary CRS
def _i(path: str, kind: str, at: int, n: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(at)
        return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)


def read_crs_head(path: str) -> dict:
    order, version, base, sym, dt = _i(path, "<i4", 0, 5).tolist()
    if order != 0:
        raise ValueError("the file is in the other byte order")
    nrows, ncols, nnz = _i(path, "<i8", 20, 3).tolist()
    dtype = DType.of(dt)
    if Symmetry(sym) != Symmetry.GENERAL:
        raise ValueError("only general matrices can be read")
    if base not in (0, 1):
        raise ValueError("indices start at 0 or 1")
    if os.path.getsize(path) != CRS_HEAD + 8 * (nrows + 1) + (8 + dtype.size) * nnz:
        raise ValueError("the file's size doesn't fit its head")
    return {"version": version, "base": base, "dtype": dtype, "nrows": nrows, "ncols": ncols, "nnz": nnz}


def _value(dtype: DType) -> pa.DataType:
    return pa.struct([("re", pa.float64()), ("im", pa.float64())]) if dtype.is_complex else pa.float64()


def _values(raw: np.ndarray, dtype: DType) -> pa.Array:
    if dtype.is_complex:
        return pa.StructArray.from_arrays([pa.array(raw.real.astype("f8")), pa.array(raw.imag.astype("f8"))], ["re", "im"])
    return pa.array(raw.astype("f8"))


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _splits(n: int, options: dict) -> list[Rows]:
    step = int(options.get("splitrows", SPLIT_ROWS))
    return [Rows(s, min(n, s + step)) for s in range(0, n, step)] or [Rows(0, 0)]


class CrsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.head = read_crs_head(self.path)

    def partitions(self):
        return _splits(self.head["nrows"], self.options)

    def read(self, part: Rows):
        h = self.head
        rpt = _i(self.path, "<i8", CRS_HEAD + 8 * part.lo, part.hi - part.lo + 1) - h["base"]
        at, names = CRS_HEAD + 8 * (h["nrows"] + 1), ["i", "j", "v"]
        s = 0
        while s < part.hi - part.lo:  # some million entries at a time, a row at least
            e = max(s + 1, int(np.searchsorted(rpt, rpt[s] + (1 << 22), "right")) - 1)
            lo, hi = int(rpt[s]), int(rpt[e])
            i = np.repeat(np.arange(part.lo + s, part.lo + e), np.diff(rpt[s : e + 1]))
            j = _i(self.path, "<i8", at + 8 * lo, hi - lo) - h["base"]
            v = _i(self.path, "<" + h["dtype"].numpy, at + 8 * h["nnz"] + h["dtype"].size * lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), _values(v, h["dtype"])], names)
            s = e


class CrsSource(DataSource):
    """format('bincrs'): (i, j, v)."""

    @classmethod
    def name(cls) -> str:
        return "bincrs"

    def schema(self) -> str:
        return "i long, j long, v " + ("struct<re:double,im:double>" if read_crs_head(self.options["path"])["dtype"].is_complex else "double")

    def reader(self, schema) -> CrsReader:
        return CrsReader(dict(self.options))


def read_bincrs(spark: SparkSession, path: str, split_rows: int = SPLIT_ROWS) -> SparseMatrix:
    spark.dataSource.register(CrsSource)
    h = read_crs_head(path)
    return SparseMatrix(spark.read.format("bincrs").option("splitrows", split_rows).load(path), h["nrows"], h["ncols"], MatrixTraits(dtype=h["dtype"]))


class _Target:
    """A file under a temporary name, of its full size from the start."""

    def __init__(self, path: str, head: list[np.ndarray], size: int):
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        with open(self.part, "wb") as f:
            for x in head:
                x.tofile(f)
            f.truncate(size)

    def fill(self, df: DataFrame, key: str, base: int, width: int, raw) -> int:
        """Executors put each row's bytes, raw(batch) giving those of all rows of a batch, to base + width * key. Returns how many rows were written."""
        part = self.part

        def run(batches):
            n = 0
            with open(part, "r+b") as f:
                for b in batches:
                    if not b.num_rows:
                        continue
                    at = b.column(key).to_numpy()
                    order = np.argsort(at, kind="stable")
                    rows, at = np.frombuffer(raw(b), f"V{width}")[order], at[order]
                    cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                    for s, e in zip(cuts, cuts[1:], strict=False):  # one write for each run of neighbours
                        f.seek(base + width * int(at[s]))
                        f.write(rows[s:e].tobytes())
                    n += len(at)
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

        return df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def done(self, whole: bool) -> None:
        if not whole:
            os.unlink(self.part)
            raise OSError(f"{self.path} could not be written whole")
        os.replace(self.part, self.path)


def _raw(col: pa.Array, dtype: DType) -> bytes:
    if dtype.is_complex:
        return (col.field("re").to_numpy() + 1j * col.field("im").to_numpy()).astype("<" + dtype.numpy).tobytes()
    return col.to_numpy().astype("<" + dtype.numpy).tobytes()


def write_bincrs(a: SparseMatrix, path: str) -> None:
    """One file; an entry's place is its rank by row and column, a row pointer's comes from sums over blocks of rows."""
    from ..operators.distribute import row_lengths

    d = a.traits.dtype
    ranked = cut(global_rank(a.df, "i", "j", *(["v.re", "v.im"] if d.is_complex else ["v"])))
    n = ranked.count()
    rpt = prefix_sum(row_lengths(a), "i", "len", "before", a.nrows).select("i", F.col("before").cast("long").alias("before"))
    at = CRS_HEAD + 8 * (a.nrows + 1)
    f = _Target(path, [np.array([0, 1, 0, Symmetry.GENERAL.value, d.value], "<i4"), np.array([a.nrows, a.ncols, n], "<i8")], at + (8 + d.size) * n)
    longs = lambda c: lambda b: b.column(c).to_numpy().astype("<i8").tobytes()
    last = a.df.sparkSession.range(1).select(F.lit(a.nrows).cast("long").alias("i"), F.lit(n).cast("long").alias("before"))
    rows = f.fill(rpt.unionAll(last), "i", CRS_HEAD, 8, longs("before"))
    cols = f.fill(ranked.select("rank", "j"), "rank", at, 8, longs("j"))
    values = f.fill(ranked.select("rank", "v"), "rank", at + 8 * n, d.size, lambda b: _raw(b.column("v"), d))
    f.done((rows, cols, values) == (a.nrows + 1, n, n))


# binary dense
def read_dense_head(path: str) -> dict:
    order, version, layout, dt = _i(path, "<i4", 0, 4).tolist()
    if order != 0 or version != 1:
        raise ValueError("byte order or version is not supported")
    nrows, ncols = _i(path, "<i8", 16, 2).tolist()
    dtype = DType.of(dt)
    if os.path.getsize(path) != DENSE_HEAD + nrows * ncols * dtype.size:
        raise ValueError("the file's size doesn't fit its head")
    return {"col_major": bool(layout), "dtype": dtype, "nrows": nrows, "ncols": ncols}


class DenseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.head = read_dense_head(self.path)

    def partitions(self):
        return _splits(self.head["nrows"], self.options)

    def read(self, part: Rows):
        h, step = self.head, 1 << 14
        d, k, size = "<" + h["dtype"].numpy, h["ncols"], h["dtype"].size
        for lo in range(part.lo, part.hi, step):
            n = min(step, part.hi - lo)
            if h["col_major"]:
                x = np.stack([_i(self.path, d, DENSE_HEAD + size * (c * h["nrows"] + lo), n) for c in range(k)], axis=1)
            else:
                x = _i(self.path, d, DENSE_HEAD + size * lo * k, n * k).reshape(n, k)
            offs = pa.array(np.arange(0, n * k + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), pa.ListArray.from_arrays(offs, _values(np.ascontiguousarray(x).ravel(), h["dtype"]))], ["i", "x"])


class DenseSource(DataSource):
    """format('bindense'): (i, x array)."""

    @classmethod
    def name(cls) -> str:
        return "bindense"

    def schema(self) -> str:
        return "i long, x array<" + ("struct<re:double,im:double>" if read_dense_head(self.options["path"])["dtype"].is_complex else "double") + ">"

    def reader(self, schema) -> DenseReader:
        return DenseReader(dict(self.options))


def read_bindense(spark: SparkSession, path: str, split_rows: int = SPLIT_ROWS) -> BlockVector:
    spark.dataSource.register(DenseSource)
    h = read_dense_head(path)
    return BlockVector(spark.read.format("bindense").option("splitrows", split_rows).load(path), h["nrows"], h["ncols"])


def write_bindense(x: BlockVector, path: str, dtype: DType = DType.D) -> None:
    """One row-major file."""
    width = dtype.size * x.ncols
    f = _Target(path, [np.array([0, 1, 0, dtype.value], "<i4"), np.array([x.nrows, x.ncols], "<i8")], DENSE_HEAD + width * x.nrows)
    f.done(f.fill(x.df.orderBy("i").select("i", "x"), "i", DENSE_HEAD, width, lambda b: _raw(b.column("x").flatten(), dtype)) == x.nrows)
