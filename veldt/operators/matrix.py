"""Sparse matrices as relations (i, j, v), equal places adding up."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dtypes import MatrixTraits


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    nrows: int
    ncols: int
    traits: MatrixTraits = field(default_factory=MatrixTraits)

    @staticmethod
    def from_df(df: DataFrame, i, j, v, nrows: int, ncols: int) -> SparseMatrix:
        c = lambda x: x if isinstance(x, Column) else F.col(x)
        return SparseMatrix(df.select(c(i).cast("long").alias("i"), c(j).cast("long").alias("j"), c(v).cast("double").alias("v")), nrows, ncols)

    @staticmethod
    def from_rows(spark: SparkSession, nrows: int, ncols: int, row: Callable[[int], Iterable[tuple[int, float]]]) -> SparseMatrix:
        """From a pure row function, called once for each row on the executors."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                i, j, v = [], [], []
                for r in b.column("id").to_pylist():
                    for col, val in row(r):
                        i.append(r)
                        j.append(col)
                        v.append(float(val))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], ["i", "j", "v"])

        return SparseMatrix(spark.range(nrows).mapInArrow(run, "i long, j long, v double"), nrows, ncols)

    @staticmethod
    def stencil(spark: SparkSession, n: int, entries: dict[int, float]) -> SparseMatrix:
        """A band matrix with constant diagonals: offset to value."""
        arr = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(float(v)).alias("v")) for o, v in entries.items()])
        df = spark.range(n).select(F.col("id").alias("i"), F.explode(arr).alias("e")).select("i", (F.col("i") + F.col("e.o")).alias("j"), F.col("e.v").alias("v"))
        return SparseMatrix(df.where(F.col("j").between(0, n - 1)), n, n)

    @staticmethod
    def from_crs(spark: SparkSession, rpt, col, val, ncols: int, row0: int = 0) -> SparseMatrix:
        rpt, n = np.asarray(rpt), len(rpt) - 1
        i = np.repeat(np.arange(row0, row0 + n), np.diff(rpt))
        rows = [(int(a), int(b), float(c)) for a, b, c in zip(i, col, val, strict=True)]
        return SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), row0 + n, ncols)

    def with_df(self, df: DataFrame) -> SparseMatrix:
        return SparseMatrix(df, self.nrows, self.ncols, self.traits)

    def nnz(self) -> int:
        return self.df.count()

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.ncols, self.nrows, self.traits)

    def symmetrized(self) -> SparseMatrix:
        """A stored triangle as a general matrix: off-diagonal entries are mirrored."""
        return self.with_df(self.df.unionAll(self.df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")))

    def coalesce_duplicates(self) -> SparseMatrix:
        return self.with_df(self.df.groupBy("i", "j").agg(F.sum("v").alias("v")))

    def packed(self) -> DataFrame:
        """(i, cols, vals) by column."""
        return self.df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e")).select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))

    def sorted_columns(self) -> DataFrame:
        """(i, pos, j, v): places within the row by column."""
        return self.df.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy("j", "v")) - 1)

    def diag_first(self) -> DataFrame:
        """(i, pos, j, v): the diagonal first, as 0 where it is missing, then by column."""
        have = self.df.where("i = j").select("i").distinct()
        n = min(self.nrows, self.ncols)
        missing = self.df.sparkSession.range(n).select(F.col("id").alias("i")).join(have, "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(0.0).alias("v"))
        w = Window.partitionBy("i").orderBy(F.col("i") != F.col("j"), "j", "v")
        return self.df.unionAll(missing).withColumn("pos", F.row_number().over(w) - 1)

    def split(self, part: Callable[[Column], Column]) -> tuple[SparseMatrix, SparseMatrix]:
        """Entries whose column belongs to the row's part, and the others."""
        own = part(F.col("i")) == part(F.col("j"))
        return self.with_df(self.df.where(own)), self.with_df(self.df.where(~own))

    def to_numpy(self) -> np.ndarray:
        out = np.zeros((self.nrows, self.ncols))
        for r in self.df.collect():
            out[r["i"], r["j"]] += r["v"]
        return out

    def to_string(self) -> str:
        """Dense text of a small matrix, . for what is not stored."""
        seen = {(r["i"], r["j"]): r["v"] for r in self.coalesce_duplicates().df.collect()}
        return "\n".join(" ".join(f"{seen[i, j]:9.2e}" if (i, j) in seen else "        ." for j in range(self.ncols)) for i in range(self.nrows))
