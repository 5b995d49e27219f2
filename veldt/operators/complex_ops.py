"""Complex matrices (i, j, v struct<re, im>) and block vectors (i, x array<struct<re, im>>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as z


def from_parts(re: DataFrame, im: DataFrame) -> DataFrame:
    """(i, x) from two real vectors."""
    return re.join(im.withColumnRenamed("x", "y"), "i").select("i", F.zip_with("x", "y", z.cplx).alias("x"))


def parts(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    return x.select("i", F.transform("x", lambda e: e["re"]).alias("x")), x.select("i", F.transform("x", lambda e: e["im"]).alias("x"))


def conj(x: DataFrame) -> DataFrame:
    return x.select("i", F.transform("x", z.conj).alias("x"))


def scale(x: DataFrame, s: complex) -> DataFrame:
    return x.select("i", F.transform("x", lambda e: z.mul(e, z.lit(s))).alias("x"))


def axpy(y: DataFrame, s: complex, x: DataFrame) -> DataFrame:
    return y.join(x.withColumnRenamed("x", "b"), "i").select("i", F.zip_with("x", "b", lambda p, q: z.add(p, z.mul(q, z.lit(s)))).alias("x"))


def _per_column(s, k: int) -> list[complex]:
    out = list(s) if isinstance(s, (list, tuple)) else [s] * k
    if len(out) != k:
        raise ValueError(f"{k} scalars are needed")
    return out


def vscale(x: DataFrame, s: list[complex]) -> DataFrame:
    return x.select("i", F.array(*[z.mul(F.col("x")[c], z.lit(v)) for c, v in enumerate(s)]).alias("x"))


def axpby(y: DataFrame, a, x: DataFrame, b, k: int) -> DataFrame:
    """a x + b y; a and b are numbers, or one for each of the k columns."""
    a, b = _per_column(a, k), _per_column(b, k)
    both = y.join(x.withColumnRenamed("x", "o"), "i")
    return both.select("i", F.array(*[z.add(z.mul(F.col("o")[c], z.lit(a[c])), z.mul(F.col("x")[c], z.lit(b[c]))) for c in range(k)]).alias("x"))


def axpbypcz(y: DataFrame, a, x: DataFrame, b, w: DataFrame, c, k: int) -> DataFrame:
    """a x + b y + c w."""
    return axpby(axpby(y, a, x, b, k), c, w, 1, k)


def mult(y: DataFrame, x: DataFrame, s: complex = 1) -> DataFrame:
    """s x y, place by place."""
    return y.join(x.withColumnRenamed("x", "o"), "i").select("i", F.zip_with("x", "o", lambda p, q: z.mul(z.mul(p, q), z.lit(s))).alias("x"))


def nrm2(x: DataFrame, k: int) -> DataFrame:
    """(c, v): the length of each column."""
    return dot(x, x, k).select("c", F.sqrt("re").alias("v"))


def dot(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """(c, re, im) of the sums of conj(x) y."""
    df = x.join(y.withColumnRenamed("x", "b"), "i")
    sums = [z.total(z.mul(z.conj(F.col("x")[c]), F.col("b")[c])).alias(f"d{c}") for c in range(k)]
    return df.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"d{c}.re").alias("re"), F.col(f"d{c}.im").alias("im")) for c in range(k)])))


def spmv(a: DataFrame, x: DataFrame, k: int, nrows: int) -> DataFrame:
    """(i, x) of A x; rows without entries are 0."""
    g = a.join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[z.total(z.mul(F.col("v"), F.col("x")[c])).alias(f"y{c}") for c in range(k)])
    rows = a.sparkSession.range(nrows).select(F.col("id").alias("i")).join(g, "i", "left")
    return rows.select("i", F.array(*[F.coalesce(f"y{c}", z.lit(0)) for c in range(k)]).alias("x"))
