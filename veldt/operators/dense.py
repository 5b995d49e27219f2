"""Dense contractions: tall-skinny products, GEMM by shape, and vT A w."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_vector import BlockVector
from .matrix import SparseMatrix


#: Products that a projection or an aggregate spells out; more would make code too large to be compiled.
LITERALS = 64


def _block(x: pa.Array, k: int) -> np.ndarray:
    """Rows of k numbers from a list column."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1), pa.int32()), pa.array(rows.ravel()))


def tsmm(v: BlockVector, w: np.ndarray, alpha: float = 1.0, beta: float = 0.0, x: BlockVector | None = None) -> BlockVector:
    """x <- alpha v w + beta x for a small w: a projection, w's entries being literals; wide ones go through numpy batches."""
    w = float(alpha) * np.asarray(w, "f8")
    m, n = w.shape
    if m != v.ncols:
        raise ValueError("w's rows must be v's columns")
    if m * n <= LITERALS:
        cols = [sum((F.col("x")[a] * float(w[a, b]) for a in range(m) if w[a, b]), F.lit(0.0)) for b in range(n)]
        out = BlockVector(v.df.select("i", F.array(*cols).alias("x")), v.nrows, n)
    else:

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("i"), _lists(_block(b.column("x"), m) @ w)], ["i", "x"])

        out = BlockVector(v.df.mapInArrow(run, "i long, x array<double>"), v.nrows, n)
    return out if not beta else out.axpby(beta, x, 1.0)


def tsmm_inplace(x: BlockVector, w: np.ndarray, alpha: float = 1.0, beta: float = 0.0) -> BlockVector:
    """The first K columns become alpha x w + beta x, the others stay: one product with w' = alpha w + beta I."""
    w = float(alpha) * np.asarray(w, "f8")
    m, k = w.shape
    w = w + float(beta) * np.eye(m, k)
    new = tsmm(x, w)
    if k == m:
        return new
    df = new.df.withColumnRenamed("x", "n").join(x.df, "i").select("i", F.concat("n", F.slice("x", k + 1, m - k)).alias("x"))
    return BlockVector(df, x.nrows, x.ncols)


def gram_df(v: BlockVector, w: BlockVector, kahan: bool = False) -> DataFrame:
    """(a, b, v) of vT w. Few sums are one aggregate; more are partial products per batch in numpy, summed by place; kahan keeps the error terms too."""
    m, n = v.ncols, w.ncols
    df = v._with(w) if v is w else v.df.join(w.df.select("i", F.col("x").alias("y")), "i")
    if m * n <= LITERALS and not kahan:
        sums = [F.sum(F.col("x")[a] * F.col("y")[b]).alias(f"s{a}_{b}") for a in range(m) for b in range(n)]
        each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"s{a}_{b}"), F.lit(0.0)).alias("v")) for a in range(m) for b in range(n)])
        return df.agg(*sums).select(F.inline(each))

    def run(batches):
        total, err = np.zeros((m, n)), np.zeros((m, n))
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _block(b.column("x"), m), _block(b.column("y"), n)
            if not kahan:
                total += x.T @ y
                continue
            step = max(1, (1 << 20) // (m * n))  # rows whose products are held at once
            for s in range(0, len(x), step):
                t = np.concatenate([total[None], x[s : s + step, :, None] * y[s : s + step, None, :]])
                while len(t) > 1:  # pairs of terms, then of their sums; what each addition loses is kept
                    h = len(t) // 2
                    p, q = t[:h], t[h : 2 * h]
                    u = p + q
                    z = u - p
                    err += ((p - (u - z)) + (q - z)).sum(axis=0)
                    t = np.concatenate([u, t[2 * h :]])
                total = t[0]
        a, b = (g.ravel().astype("i4") for g in np.indices((m, n)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total.ravel()), pa.array(err.ravel())], ["a", "b", "v", "e"])

    parts = df.select("x", "y").mapInArrow(run, "a int, b int, v double, e double")
    if not kahan:
        return parts.groupBy("a", "b").agg(F.sum("v").alias("v"))
    own = parts.groupBy("a", "b").agg(F.collect_list(F.struct("v", "e")).alias("p"))  # a pair for each task

    def exact(batches):
        for b in batches:
            vals = [math.fsum([q for r in p for q in (r["v"], r["e"])]) for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(vals, pa.float64())], ["a", "b", "v"])

    return own.mapInArrow(exact, "a int, b int, v double")


def tsmttsm(v: BlockVector, w: BlockVector, alpha: float = 1.0, beta: float = 0.0, x: np.ndarray | None = None, kahan: bool = False) -> np.ndarray:
    """alpha vT w + beta x, small."""
    return _small(gram_df(v, w, kahan), v.ncols, w.ncols, alpha, beta, x)


def _small(df: DataFrame, m: int, n: int, alpha: float, beta: float, x: np.ndarray | None) -> np.ndarray:
    out = np.zeros((m, n))
    for r in df.collect():
        out[r["a"], r["b"]] = r["v"]
    return alpha * out + (beta * np.asarray(x) if beta else 0)


def tsmtspmtsm_df(v: BlockVector, a: SparseMatrix, w: BlockVector) -> DataFrame:
    """(a, b, v) of vT A w: A w by rows, then one aggregate with v."""
    from .spmv import product

    return gram_df(v, BlockVector(product(a, w).select("i", F.col("ax").alias("x")), a.nrows, w.ncols))


def tsmtspmtsm(v: BlockVector, a: SparseMatrix, w: BlockVector, alpha: float = 1.0, beta: float = 0.0, x: np.ndarray | None = None) -> np.ndarray:
    """alpha vT A w + beta x, small."""
    return _small(tsmtspmtsm_df(v, a, w), v.ncols, w.ncols, alpha, beta, x)


def gemm(v, w, alpha: float = 1.0, beta: float = 0.0, x=None, trans_v: str = "N", trans_w: str = "N"):
    """alpha op(v) op(w) + beta x, op being N, T or C (alike for real numbers). A tall operand is a BlockVector, a small one an array.

    tall N times small is tall; tall T times tall N is small; small times tall T is tall and given back transposed, as is anything that is wide: a BlockVector
    whose rows are the product's columns. tall N times tall T would be a square matrix of all rows, and is refused.
    """
    tall_v, tall_w = isinstance(v, BlockVector), isinstance(w, BlockVector)
    if trans_v not in "NTC" or trans_w not in "NTC":
        raise ValueError("an operand is taken as N, T or C")
    flip = lambda m, t: np.asarray(m).T if t in "TC" else np.asarray(m)
    if not tall_v and not tall_w:
        return alpha * flip(v, trans_v) @ flip(w, trans_w) + (beta * np.asarray(x) if beta else 0)
    if tall_v and tall_w:
        if trans_v in "TC" and trans_w == "N":
            return tsmttsm(v, w, alpha, beta, x)
        raise ValueError("this combination of tall operands has no small or tall result")
    if tall_v:
        if trans_v == "N":
            return tsmm(v, flip(w, trans_w), alpha, beta, x)
        # op(v) is wide, so op(w) must have as many rows as v: then w is as tall, and small only in columns
        w = flip(w, trans_w)
        return tsmttsm(v, BlockVector.from_numpy(v.df.sparkSession, w), alpha, beta, x)
    v = flip(v, trans_v)
    if trans_w in "TC":  # (small times tall T) is (tall times small T) T
        return tsmm(w, v.T, alpha, beta, x)
    return tsmttsm(BlockVector.from_numpy(w.df.sparkSession, v.T), w, alpha, beta, x)
