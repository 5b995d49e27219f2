"""Sparse matrix times block vector, with the fused options: y <- alpha (A - gamma I) x + beta y; z <- delta z + eta y; dots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dtypes import check_mat_vec
from .block_vector import BlockVector, Scalar, _per_column
from .matrix import SparseMatrix


MODES = ("vector", "overlap", "task", "pipelined", "nocomm")


@dataclass(frozen=True)
class SpmvOpts:
    """Of the modes, vector, overlap, task and pipelined differ in how data moves, which is the planner's business here; nocomm moves none, so that each part
    sees its own columns alone (with no parts there is one, which has all). barrier changes nothing."""

    alpha: float | None = None
    axpy: bool = False
    beta: float | None = None
    shift: Scalar | None = None
    chain: tuple[float, float] | None = None  # delta, eta
    dots: bool = False
    reduce: bool = True
    part: Callable[[Column], Column] | None = None  # owner of a row
    only: str | None = None  # local or remote entries
    blocksz: int | None = None
    mode: str = "vector"
    barrier: bool = False


@dataclass(frozen=True)
class SpmvResult:
    y: BlockVector
    z: BlockVector | None = None
    dots: DataFrame | None = None  # ([part,] c, yy, xy, xx)
    held: DataFrame | None = None  # kept in executors for y, z and the dots

    def release(self) -> None:
        """Lets go of what is kept, once y, z and the dots have been read."""
        if self.held is not None:
            self.held.unpersist()


def product(a: SparseMatrix, x: BlockVector) -> DataFrame:
    """(i, x) of rows with entries: one join on the column, sums that start before the shuffle."""
    k = x.ncols
    xs = x.df.select(F.col("i").alias("j"), *[F.col("x")[c].alias(f"x{c}") for c in range(k)])
    g = a.df.join(xs, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(f"x{c}")).alias(f"y{c}") for c in range(k)])
    return g.select("i", F.array(*[f"y{c}" for c in range(k)]).alias("ax"))


def spmv(a: SparseMatrix, x: BlockVector, opts: SpmvOpts = SpmvOpts(), y: BlockVector | None = None, z: BlockVector | None = None) -> SpmvResult:
    check_mat_vec(a, x, y)
    o, k = opts, x.ncols
    if o.mode not in MODES:
        raise ValueError(f"no mode is called {o.mode}")
    if o.mode == "nocomm" and o.part is not None and o.only != "remote":
        a = a.split(o.part)[0]
    if o.only:
        if o.part is None:
            raise ValueError("local and remote parts need the rows' owners")
        near, far = a.split(o.part)
        a = near if o.only == "local" else far
        o = SpmvOpts(alpha=o.alpha, axpy=o.axpy or o.only == "remote", beta=None if o.only == "remote" else o.beta, shift=None if o.only == "remote" else o.shift, part=o.part)
    if o.blocksz and o.blocksz < k and not o.dots and o.chain is None:
        parts = []
        for s in range(0, k, o.blocksz):
            n = min(o.blocksz, k - s)
            shift = _per_column(o.shift, k)[s : s + n] if o.shift is not None else None
            own = SpmvOpts(o.alpha, o.axpy, o.beta, shift)
            parts.append(spmv(a, x.view(0, x.nrows, s, n), own, y and y.view(0, y.nrows, s, n)).y)
        df = parts[0].df
        for p in parts[1:]:
            df = df.join(p.df.withColumnRenamed("x", "more"), "i").select("i", F.concat("x", "more").alias("x"))
        return SpmvResult(BlockVector(df, a.nrows, k))
    adds = o.axpy or o.beta is not None
    if adds and y is None or o.chain and z is None:
        raise ValueError("y or z is missing")
    if o.shift is not None and a.nrows != a.ncols:
        raise ValueError("a shift needs a square matrix")
    spark = a.df.sparkSession
    rows = y.df.select("i", F.col("x").alias("y")) if adds else spark.range(a.nrows).select(F.col("id").alias("i"))
    rows = rows.join(product(a, x), "i", "left")
    if o.shift is not None or o.dots:
        rows = rows.join(x.df, "i", "left")
    if o.chain:
        rows = rows.join(z.df.select("i", F.col("x").alias("z")), "i")
    zero = F.lit(0.0)
    val = lambda name, c: F.coalesce(F.col(name)[c], zero)
    shift = _per_column(o.shift, k) if o.shift is not None else None

    def new_y(c: int) -> Column:
        v = val("ax", c)
        if shift:
            v = v - shift[c] * val("x", c)
        if o.alpha is not None:
            v = float(o.alpha) * v
        if o.axpy:
            v = F.col("y")[c] + v
        elif o.beta is not None:
            v = float(o.beta) * F.col("y")[c] + v
        return v

    keep = [n for n in ("x", "z") if n in rows.columns]
    out = rows.select("i", F.array(*[new_y(c) for c in range(k)]).alias("ny"), *keep)
    if o.dots:
        out = out.persist()  # read for y, z and the dots
    res_z = None
    if o.chain:
        d, e = map(float, o.chain)
        res_z = BlockVector(out.select("i", F.array(*[d * F.col("z")[c] + e * F.col("ny")[c] for c in range(k)]).alias("x")), a.nrows, k)
    dots = None
    if o.dots:
        ny = lambda c: F.col("ny")[c]
        sums = [s for c in range(k) for s in (F.sum(ny(c) * ny(c)).alias(f"yy{c}"), F.sum(val("x", c) * ny(c)).alias(f"xy{c}"), F.sum(val("x", c) * val("x", c)).alias(f"xx{c}"))]
        by = [] if o.reduce or o.part is None else [o.part(F.col("i")).alias("part")]
        each = F.array(*[F.struct(F.lit(c).alias("c"), *[F.col(f"{n}{c}").alias(n) for n in ("yy", "xy", "xx")]) for c in range(k)])
        dots = out.groupBy(*by).agg(*sums).select(*["part"] * len(by), F.inline(each))
    return SpmvResult(BlockVector(out.select("i", F.col("ny").alias("x")), a.nrows, k), res_z, dots, out if o.dots else None)
