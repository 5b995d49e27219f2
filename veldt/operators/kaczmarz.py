"""Row projections: x <- x + omega (b_i - a_i x) / |a_i|^2 conj(a_i), in sweeps, by colours, and averaged over parts (CARP)."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.util import cut
from . import permute
from .block_vector import BlockVector
from .distribute import by_rows, owner
from .matrix import SparseMatrix


def row_normalized(a: SparseMatrix, b: BlockVector | None = None) -> tuple[SparseMatrix, BlockVector | None, DataFrame]:
    """A and b with rows divided by |a_i|, and (i, norm). Empty rows stay; a row of zeros becomes NaN."""
    norms = a.df.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    nan = lambda v, n: F.when(n == 0, F.lit(float("nan"))).otherwise(v / F.when(n == 0, F.lit(1.0)).otherwise(n))
    na = a.with_df(a.df.join(norms, "i").select("i", "j", nan(F.col("v"), F.col("norm")).alias("v")))
    if b is None:
        return na, None, norms
    df = b.df.join(norms, "i", "left").select("i", F.transform("x", lambda e: nan(e, F.coalesce(F.col("norm"), F.lit(1.0)))).alias("x"))
    return na, BlockVector(df, b.nrows, b.ncols), norms


def color_step(a: SparseMatrix, b: BlockVector | None, x: BlockVector, rows: DataFrame | None = None, omega: float = 1.0) -> BlockVector:
    """One projection onto each of rows(i) at once; they must share no column. One column."""
    e = a.df if rows is None else a.df.join(rows.select("i"), "i", "left_semi")
    ax = e.join(x.df.select(F.col("i").alias("j"), F.col("x")[0].alias("xj")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xj")).alias("ax"), F.sum(F.col("v") * F.col("v")).alias("nn"))
    if b is not None:
        ax = ax.join(b.df.select("i", F.col("x")[0].alias("b")), "i")
    res = ax.select("i", ((F.col("b") if b is not None else F.lit(0.0)) - F.col("ax")).alias("r"), "nn").where("nn > 0")
    upd = e.join(res, "i").groupBy("j").agg(F.sum(F.lit(float(omega)) * F.col("r") / F.col("nn") * F.col("v")).alias("d"))
    df = x.df.join(upd.withColumnRenamed("j", "i"), "i", "left").select("i", F.array(F.col("x")[0] + F.coalesce("d", F.lit(0.0))).alias("x"))
    return BlockVector(df, x.nrows, 1)


def color_sweep(a: SparseMatrix, b: BlockVector | None, x: BlockVector, colors: DataFrame, omega: float = 1.0, backward: bool = False) -> BlockVector:
    """Colour after colour; each is one parallel step."""
    ks = sorted((r["color"] for r in colors.select("color").distinct().collect()), reverse=backward)
    for k in ks:
        x = color_step(a, b, x, colors.where(F.col("color") == k), omega)
        x = BlockVector(cut(x.df), x.nrows, 1)
    return x


def sweep_rows(i, j, v, b: dict, x: dict, omega: complex, shift: complex = 0, backward: bool = False) -> None:
    """Row after row, in place, in numpy; entries come sorted by row."""
    cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    spans = list(zip(cuts, [*cuts[1:], len(i)], strict=True))
    for s, e in reversed(spans) if backward else spans:
        row, cols, vals = int(i[s]), j[s:e].tolist(), v[s:e]
        if shift:
            vals = vals.astype("c16")
            if row in cols:
                vals[cols.index(row)] -= shift
            else:
                cols, vals = [*cols, row], np.append(vals, -shift)
        nn = float((abs(vals) ** 2).sum())
        if nn == 0:
            continue
        r = omega * (b.get(row, 0.0) - sum(w * x[c] for w, c in zip(vals, cols, strict=True))) / nn
        for c, w in zip(cols, np.conj(vals), strict=True):
            x[c] += r * w


def part_sweep(a: SparseMatrix, b: BlockVector | None, x: BlockVector, part: Callable[[Column], Column], omega: float = 1.0, backward: bool = False) -> DataFrame:
    """(part, j, x): each part sweeps its own rows, one after the other, on its own copy of the x that they touch. A part must fit one task."""
    return _part_rows(a.df.withColumn("part", part(F.col("i"))), b, x, omega, backward)


def _part_rows(rows: DataFrame, b: BlockVector | None, x: BlockVector, omega: float, backward: bool) -> DataFrame:
    """part_sweep of rows(part, i, j, v)."""
    if b is not None:
        rows = rows.join(b.df.select("i", F.col("x")[0].alias("b")), "i")
    else:
        rows = rows.withColumn("b", F.lit(0.0))
    rows = rows.join(x.df.select(F.col("i").alias("j"), F.col("x")[0].alias("xj")), "j").select("part", "i", "j", "v", "b", "xj")

    def run(key, t):
        t = t.sort_by([("i", "ascending"), ("j", "ascending")])
        i, j, v, bb, xj = (t[c].to_numpy() for c in ("i", "j", "v", "b", "xj"))
        xs = dict(zip(j.tolist(), xj.tolist(), strict=True))
        sweep_rows(i, j, v, dict(zip(i.tolist(), bb.tolist(), strict=True)), xs, omega, 0, backward)
        p = key[0].as_py()
        return pa.table({"part": pa.array([p] * len(xs), pa.int32()), "j": pa.array(list(xs), pa.int64()), "x": pa.array([float(q) for q in xs.values()])})

    return rows.groupBy("part").applyInArrow(run, "part int, j long, x double")


def halo_average(parts: DataFrame, x: BlockVector) -> BlockVector:
    """(part, j, x) to x: the mean over the parts that hold j, the old value where none does."""
    avg = parts.groupBy("j").agg(F.avg("x").alias("m"))
    df = x.df.join(avg.withColumnRenamed("j", "i"), "i", "left").select("i", F.array(F.coalesce("m", F.col("x")[0])).alias("x"))
    return BlockVector(df, x.nrows, 1)


def kaczmarz(a: SparseMatrix, b: BlockVector | None, x: BlockVector, omega: float = 1.0, backward: bool = False) -> BlockVector:
    """One sweep in strict row order, so in one task: for matrices that fit one; others take colours, zones or CARP."""
    return halo_average(part_sweep(a, b, x, lambda i: F.lit(0), omega, backward), x)


def zone_sweep(a: SparseMatrix, b: BlockVector | None, x: BlockVector, zone: Callable[[Column], Column], phases: int = 2, omega: float = 1.0, backward: bool = False) -> BlockVector:
    """Red-black (2 phases) or block multi-colour (4): zones of a phase, which share no column, sweep at once."""
    for ph in reversed(range(phases)) if backward else range(phases):
        own = a.with_df(a.df.where(zone(F.col("i")) % phases == ph))
        x = halo_average(part_sweep(own, b, x, zone, omega, backward), x)
        x = BlockVector(cut(x.df), x.nrows, 1)
    return x


def carp(a: SparseMatrix, b: BlockVector | None, x: BlockVector, part: Callable[[Column], Column], omega: float = 1.0, iterations: int = 1) -> BlockVector:
    """Forward and backward sweeps of all parts, each followed by averaging."""
    for _ in range(iterations):
        for backward in (False, True):
            x = halo_average(part_sweep(a, b, x, part, omega, backward), x)
            x = BlockVector(cut(x.df), x.nrows, 1)
    return x


def block_multicolor(a: SparseMatrix, b: BlockVector | None, x: BlockVector, zones: int = 4, omega: float = 1.0, backward: bool = False) -> BlockVector:
    """Block multi-colour sweep: rows within one slice of columns, each slice as a block; then rows over two neighbouring slices, every other pair at once; then the rest of the rows by colours."""
    where = cut(permute.block_zones(a, zones))
    rest = a.with_df(a.df.join(where.where(F.col("zone") == 2 * zones).select("i"), "i", "left_semi"))
    colors = None if rest.df.isEmpty() else cut(permute.color(rest).join(rest.df.select("i").distinct(), "i"))
    z = F.col("zone")
    phases = [z % 2 == 0, z % 4 == 1, z % 4 == 3]
    marked = a.df.join(where.where(z < 2 * zones), "i")

    def blocks(x: BlockVector) -> BlockVector:
        for phase in reversed(phases) if backward else phases:
            own = marked.where(phase)
            x = halo_average(_part_rows(own.withColumnRenamed("zone", "part"), b, x, omega, backward), x)
            x = BlockVector(cut(x.df), x.nrows, 1)
        return x

    def others(x: BlockVector) -> BlockVector:
        return x if colors is None else color_sweep(rest, b, x, colors, omega, backward)

    return blocks(others(x)) if backward else others(blocks(x))


def shifted_part_sweep(a: SparseMatrix, b: DataFrame | None, x: DataFrame, shifts: list[complex], part: Callable[[Column], Column], omega: float = 1.0, backward: bool = False) -> DataFrame:
    """x(i, k, re, im) after each column k was swept with A - shifts[k] I, b being (i, re, im). Each part sweeps its own rows, on its own copy of the x that they
    touch, and what several parts hold is averaged: a task for each part and shift, of the part's size."""
    stored = a.df.groupBy("i").agg(F.max((F.col("i") == F.col("j")).cast("int")).alias("own"))
    diag = stored.where((F.col("own") == 0) & (F.col("i") < a.ncols)).select("i", F.col("i").alias("j"), F.lit(0.0).alias("v"))  # a shift is an entry, stored or not
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(complex(s).real).alias("sr"), F.lit(complex(s).imag).alias("si")) for k, s in enumerate(shifts)])
    rows = a.df.unionAll(diag).withColumn("part", part(F.col("i")))
    zero = F.lit(0.0)
    rows = rows.join(b.select("i", F.col("re").alias("br"), F.col("im").alias("bi")), "i", "left") if b is not None else rows.withColumn("br", zero).withColumn("bi", zero)
    rows = rows.select("part", "i", "j", "v", F.coalesce("br", zero).alias("br"), F.coalesce("bi", zero).alias("bi"), F.inline(arr))
    rows = rows.join(x.select(F.col("i").alias("j"), "k", "re", "im"), ["j", "k"]).select("part", "k", "i", "j", "v", "br", "bi", "sr", "si", "re", "im")

    def run(key, t):
        t = t.sort_by([("i", "ascending"), ("j", "ascending"), ("v", "ascending")])
        c = {n: t[n].to_numpy() for n in t.column_names}
        xs = dict(zip(c["j"].tolist(), (c["re"] + 1j * c["im"]).tolist(), strict=True))
        sweep_rows(c["i"], c["j"], c["v"], dict(zip(c["i"].tolist(), (c["br"] + 1j * c["bi"]).tolist(), strict=True)), xs, omega, complex(c["sr"][0], c["si"][0]), backward)
        val = np.array(list(xs.values()))
        return pa.table({"k": pa.array([key[1].as_py()] * len(xs), pa.int32()), "i": pa.array(list(xs), pa.int64()), "nr": pa.array(val.real), "ni": pa.array(val.imag)})

    new = rows.groupBy("part", "k").applyInArrow(run, "k int, i long, nr double, ni double").groupBy("i", "k").agg(F.avg("nr").alias("nr"), F.avg("ni").alias("ni"))
    return x.join(new, ["i", "k"], "left").select("i", "k", F.coalesce("nr", "re").alias("re"), F.coalesce("ni", "im").alias("im"))


def shifted_sweep(a: SparseMatrix, b: np.ndarray | None, x: np.ndarray, shifts: list[complex], omega: float = 1.0, backward: bool = False) -> np.ndarray:
    """shifted_part_sweep of one part, for vectors that the driver holds."""
    spark = a.df.sparkSession
    x, table = np.asarray(x, "c16"), lambda rows, more: spark.createDataFrame(rows, f"i long, {more}re double, im double")
    start = table([(i, k, float(v.real), float(v.imag)) for (i, k), v in np.ndenumerate(x)], "k int, ")
    rhs = None if b is None else table([(i, float(v.real), float(v.imag)) for i, v in enumerate(np.asarray(b, "c16"))], "")
    out = x.copy()
    for r in shifted_part_sweep(a, rhs, start, shifts, lambda i: F.lit(0), omega, backward).collect():
        out[r["i"], r["k"]] = complex(r["re"], r["im"])
    return out


def tune_parts(a: SparseMatrix, b: BlockVector | None, x: BlockVector, choices: list[int], iterations: int = 1, clock: Callable[[], float] = time.perf_counter) -> list[tuple[int, float, float]]:
    """(parts, seconds, GF/s) of CARP iterations for each number of parts, the fastest first: what a sweep's width should be is measured."""
    nnz, out = a.nnz(), []
    for parts in choices:
        t = clock()
        carp(a, b, x, owner(by_rows(a.nrows, parts)), iterations=iterations).df.agg(F.count("*")).first()
        t = clock() - t
        out.append((parts, t, 8e-9 * nnz * iterations / t if t else float("inf")))  # forward and backward: four operations an entry each
    return sorted(out, key=lambda r: r[1])


def zone_report(a: SparseMatrix, zone: Callable[[Column], Column]) -> DataFrame:
    """(zone, n_rows, nnz, lo, hi): lo and hi are the zone's first and last column."""
    return a.df.groupBy(zone(F.col("i")).alias("zone")).agg(F.countDistinct("i").alias("n_rows"), F.count("*").alias("nnz"), F.min("j").alias("lo"), F.max("j").alias("hi"))
