"""Block vectors: rows (i, x array<double>), their constructors, views, BLAS-1 and reductions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dtypes import check_ascending, check_same_shape

Scalar = float | list[float]


def _per_column(a: Scalar, k: int) -> list[float]:
    out = [float(v) for v in a] if isinstance(a, (list, tuple, np.ndarray)) else [float(a)] * k
    if len(out) != k:
        raise ValueError(f"{k} scalars are needed")
    return out


@dataclass(frozen=True)
class BlockVector:
    df: DataFrame
    nrows: int
    ncols: int

    # constructors
    @staticmethod
    def from_columns(df: DataFrame, i: str, cols: list, nrows: int) -> BlockVector:
        return BlockVector(df.select(F.col(i).cast("long").alias("i"), F.array(*[(c if isinstance(c, Column) else F.col(c)).cast("double") for c in cols]).alias("x")), nrows, len(cols))

    @staticmethod
    def from_scalar(spark: SparkSession, nrows: int, ncols: int, v: float) -> BlockVector:
        return BlockVector(spark.range(nrows).select(F.col("id").alias("i"), F.array_repeat(F.lit(float(v)), ncols).alias("x")), nrows, ncols)

    @staticmethod
    def rand(spark: SparkSession, nrows: int, ncols: int, seed: int = 0) -> BlockVector:
        """Uniform on [-1, 1]."""
        return BlockVector(spark.range(nrows).select(F.col("id").alias("i"), F.array(*[2 * F.rand(seed + c) - 1 for c in range(ncols)]).alias("x")), nrows, ncols)

    @staticmethod
    def from_func(spark: SparkSession, nrows: int, ncols: int, f: Callable[[Column, Column], Column]) -> BlockVector:
        """x(i, c) = f(i, c), an expression."""
        return BlockVector(spark.range(nrows).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(ncols - 1)), lambda c: f(F.col("id"), c).cast("double")).alias("x")), nrows, ncols)

    @staticmethod
    def from_numpy(spark: SparkSession, a: np.ndarray) -> BlockVector:
        a = np.atleast_2d(np.asarray(a, "f8").T).T
        return BlockVector(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, x array<double>"), *a.shape)

    @staticmethod
    def from_tidy(df: DataFrame, nrows: int, ncols: int) -> BlockVector:
        """From (i, c, v); what is missing is 0."""
        g = df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
        return BlockVector(g.select("i", F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in range(ncols)]).alias("x")), nrows, ncols)

    # forms
    def tidy(self) -> DataFrame:
        return self.df.select("i", F.posexplode("x").alias("c", "v"))

    def to_numpy(self) -> np.ndarray:
        """Gathers a small vector."""
        out = np.zeros((self.nrows, self.ncols))
        for r in self.df.collect():
            out[r["i"]] = r["x"]
        return out

    def col(self, c: int) -> Column:
        return F.col("x")[c]

    def _map(self, f: Callable[[int], Column], ncols: int | None = None) -> BlockVector:
        k = self.ncols if ncols is None else ncols
        return BlockVector(self.df.select("i", F.array(*[f(c) for c in range(k)]).alias("x")), self.nrows, k)

    def _zip(self, f: Callable[..., Column], *others: BlockVector) -> BlockVector:
        """f of the columns' places, over rows aligned by i."""
        df = self.df.select("i", F.col("x").alias("x0"))
        for n, o in enumerate(others, 1):
            df = df.join(o.df.select("i", F.col("x").alias(f"x{n}")), "i")
        cols = [f(c, *[F.col(f"x{n}")[c] for n in range(len(others) + 1)]) for c in range(self.ncols)]
        return BlockVector(df.select("i", F.array(*cols).alias("x")), self.nrows, self.ncols)

    # views
    def view(self, row0: int, nrows: int, col0: int, ncols: int) -> BlockVector:
        """Rows and columns in one stretch, renumbered from 0."""
        if not (0 <= row0 and row0 + nrows <= self.nrows and 0 <= col0 and col0 + ncols <= self.ncols):
            raise ValueError("the view leaves the vector")
        df = self.df.where(F.col("i").between(row0, row0 + nrows - 1)).select((F.col("i") - row0).alias("i"), F.slice("x", col0 + 1, ncols).alias("x"))
        return BlockVector(df, nrows, ncols)

    def strided(self, row0: int, nrows: int, step: int, col0: int = 0, ncols: int | None = None) -> BlockVector:
        """Every step-th row from row0 on, nrows of them, renumbered from 0."""
        ncols = self.ncols - col0 if ncols is None else ncols
        if step < 1 or row0 < 0 or (nrows and row0 + (nrows - 1) * step >= self.nrows) or col0 < 0 or col0 + ncols > self.ncols:
            raise ValueError("the view leaves the vector")
        at = F.col("i") - row0
        df = self.df.where(at.between(0, (nrows - 1) * step) & (at % step == 0)).select((at / step).cast("long").alias("i"), F.slice("x", col0 + 1, ncols).alias("x"))
        return BlockVector(df, nrows, ncols)

    def transposed(self) -> np.ndarray:
        """The other way round, of a vector that the driver can hold."""
        return self.to_numpy().T

    def to_string(self) -> str:
        """Text of a small vector, a line a row."""
        return "\n".join(" ".join(f"{v:9.2e}" for v in row) for row in self.to_numpy())

    def columns(self, idx: list[int]) -> BlockVector:
        check_ascending(idx, self.ncols)
        return self._map(lambda c: F.col("x")[idx[c]], len(idx))

    def rows(self, idx: DataFrame, n: int, cols: list[int]) -> BlockVector:
        """Scattered rows, numbered by idx(i, to)."""
        check_ascending(cols, self.ncols)
        df = self.df.join(idx.select("i", "to"), "i").select(F.col("to").alias("i"), F.array(*[F.col("x")[c] for c in cols]).alias("x"))
        return BlockVector(df, n, len(cols))

    def update_rows(self, other: BlockVector) -> BlockVector:
        """Writing through a view: other's rows replace ours."""
        df = self.df.join(other.df.withColumnRenamed("x", "y"), "i", "left").select("i", F.coalesce("y", "x").alias("x"))
        return BlockVector(df, self.nrows, self.ncols)

    def entry(self, i: int, c: int) -> DataFrame:
        return self.df.where(F.col("i") == i).select(F.col("x")[c].alias("v"))

    # element-wise
    def axpy(self, a: Scalar, x: BlockVector) -> BlockVector:
        check_same_shape(self, x)
        s = _per_column(a, self.ncols)
        return self._zip(lambda c, y, x: y + s[c] * x, x)

    def axpby(self, a: Scalar, x: BlockVector, b: Scalar) -> BlockVector:
        check_same_shape(self, x)
        s, t = _per_column(a, self.ncols), _per_column(b, self.ncols)
        return self._zip(lambda c, y, x: s[c] * x + t[c] * y, x)

    def axpbypcz(self, a: Scalar, x: BlockVector, b: Scalar, c_: Scalar, z: BlockVector) -> BlockVector:
        check_same_shape(self, x, z)
        s, t, u = (_per_column(v, self.ncols) for v in (a, b, c_))
        return self._zip(lambda c, y, x, z: s[c] * x + t[c] * y + u[c] * z, x, z)

    def scale(self, s: Scalar) -> BlockVector:
        f = _per_column(s, self.ncols)
        return self._map(lambda c: F.col("x")[c] * f[c])

    def mult(self, a: float, x: BlockVector) -> BlockVector:
        """y(i, c) *= a x(i, c), or a x(i) if x has one column."""
        one = x.ncols == 1
        if not one:
            check_same_shape(self, x)
        df = self.df.join(x.df.withColumnRenamed("x", "m"), "i")
        cols = [F.col("x")[c] * (float(a) * F.col("m")[0 if one else c]) for c in range(self.ncols)]
        return BlockVector(df.select("i", F.array(*cols).alias("x")), self.nrows, self.ncols)

    def conj(self) -> BlockVector:
        return self

    def normalize(self) -> BlockVector:
        """Each column to length 1; a zero column becomes NaN."""
        n = self.nrm2()
        return self._map(lambda c: F.col("x")[c] / n[c] if n[c] else F.lit(float("nan")))

    # reductions: k numbers, whatever the rows
    def _with(self, o: BlockVector) -> DataFrame:
        if o is self:
            return self.df.select("i", "x", F.col("x").alias("y"))
        check_same_shape(self, o)
        return self.df.join(o.df.select("i", F.col("x").alias("y")), "i")

    def dot_df(self, o: BlockVector, part: Column | None = None) -> DataFrame:
        """(c, dot), or (part, c, dot) without the sum over parts."""
        sums = [F.sum(F.col("x")[c] * F.col("y")[c]).alias(f"d{c}") for c in range(self.ncols)]
        df = self._with(o)
        g = df.groupBy(part.alias("part")).agg(*sums) if part is not None else df.agg(*sums)
        keep = ["part"] if part is not None else []
        return g.select(*keep, F.posexplode(F.array(*[F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in range(self.ncols)])).alias("c", "dot"))

    def dot(self, o: BlockVector) -> list[float]:
        return [r["dot"] for r in sorted(self.dot_df(o).collect(), key=lambda r: r["c"])]

    def norm_df(self, p: float = 1.0) -> DataFrame:
        """(c, norm): the sum of (x^2)^p."""
        sums = [F.coalesce(F.sum(F.pow(F.col("x")[c] * F.col("x")[c], F.lit(float(p)))), F.lit(0.0)) for c in range(self.ncols)]
        return self.df.agg(F.array(*sums).alias("n")).select(F.posexplode("n").alias("c", "norm"))

    def nrm2(self) -> list[float]:
        return [v**0.5 for v in self.dot(self)]


def reduce_parts(df: DataFrame, ncols: int) -> DataFrame:
    """(part, i, x) to (i, x): the sum of the parts' copies."""
    return df.groupBy("i").agg(F.array(*[F.sum(F.col("x")[c]) for c in range(ncols)]).alias("x"))


def sync_parts(df: DataFrame, root: int) -> DataFrame:
    """(part, i, x) with the root's values in every part that holds the row; rows that the root lacks stay as they are."""
    own = df.where(F.col("part") == root).select("i", F.col("x").alias("r"))
    return df.join(own, "i", "left").select("part", "i", F.coalesce("r", "x").alias("x"))
