"""Statistics of matrices, all aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.util import global_rank
from .distribute import row_lengths
from .matrix import SparseMatrix


def row_profile(a: SparseMatrix) -> DataFrame:
    """(i, len, lo, hi, avg_low, avg_up) of rows with entries: the averages are over the entries strictly below and strictly above the diagonal, 0 where there are none."""
    d = F.col("j") - F.col("i")
    low, up = F.when(d < 0, -d), F.when(d > 0, d)
    return a.df.groupBy("i").agg(F.count("*").alias("len"), F.min("j").alias("lo"), F.max("j").alias("hi"), F.coalesce(F.avg(low), F.lit(0.0)).alias("avg_low"), F.coalesce(F.avg(up), F.lit(0.0)).alias("avg_up"))


def summary(a: SparseMatrix) -> DataFrame:
    """One row: bandwidths, average row bands, row lengths and their spread. Averages are over all rows; a row without entries has no band (0), and 1 as average row band of averages."""
    r = row_profile(a)
    n = a.nrows
    s = r.agg(
        F.sum("len").alias("nnz"),
        F.max(F.col("i") - F.col("lo")).alias("low"),
        F.max(F.col("hi") - F.col("i")).alias("up"),
        (F.sum(F.col("hi") - F.col("lo") + 1) / F.lit(n)).alias("avg_row_band"),
        (F.sum(F.col("avg_low") + F.col("avg_up")) / F.lit(n) + 1).alias("avg_avg_row_band"),
        F.max("len").alias("max_len"),
        F.sum(F.col("len") * F.col("len")).alias("sq"),
        F.count("*").alias("full"),
    )
    low, up = F.greatest("low", F.lit(0)), F.greatest("up", F.lit(0))
    mean = F.col("nnz") / F.lit(n)
    var = (F.col("sq") - 2 * mean * F.col("nnz") + F.col("full") * mean * mean) / F.lit(n)
    return s.select("nnz", low.alias("lower_bandwidth"), up.alias("upper_bandwidth"), (low + up + 1).alias("bandwidth"), "avg_row_band", "avg_avg_row_band", mean.alias("avg_row_len"), var.alias("row_len_variance"), F.sqrt(var).alias("row_len_deviation"), (F.sqrt(var) / mean).alias("row_len_cv"), "max_len")


def longest_rows(a: SparseMatrix) -> DataFrame:
    """(max_len, n_rows)."""
    g = a.df.groupBy("i").agg(F.count("*").alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    return g.agg(F.max(F.struct("len", "n")).alias("m")).select(F.col("m.len").alias("max_len"), F.col("m.n").alias("n_rows"))


def smart_row_band(a: SparseMatrix) -> int:
    """Median over rows of the 90th percentile of the distances below and above the diagonal, each at index floor(n q); their sum + 1."""
    out = 1
    for side in (F.col("i") - F.col("j"), F.col("j") - F.col("i")):
        d = a.df.select("i", side.alias("d")).where("d >= 0")
        w = Window.partitionBy("i")
        at = d.withColumn("r", F.row_number().over(w.orderBy("d")) - 1).withColumn("n", F.count("*").over(w)).where("r = floor(n * 0.9)").select("i", "d")
        ranked = global_rank(at, "d", "i")
        n = ranked.count()
        row = ranked.where(F.col("rank") == n // 2).select("d").first()
        out += row["d"] if row else 0
    return out


def nz_dist(a: SparseMatrix) -> DataFrame:
    """(d, n): entries by distance j - i."""
    return a.df.groupBy((F.col("j") - F.col("i")).alias("d")).agg(F.count("*").alias("n"))


def chunks(a: SparseMatrix, c: int, t: int = 1) -> DataFrame:
    """(chunk, chunk_len, chunk_min, padded): row lengths in chunks of c rows, the longest padded to a multiple of t."""
    g = row_lengths(a).groupBy(F.floor(F.col("i") / c).cast("long").alias("chunk")).agg(F.max("len").alias("chunk_len"), F.min("len").alias("chunk_min"))
    return g.withColumn("padded", (F.ceil(F.col("chunk_len") / t) * t).cast("long"))


def chunk_occupancy(a: SparseMatrix, c: int, t: int = 1) -> DataFrame:
    """(nnz, n_ents, beta): entries against stored places."""
    ents = chunks(a, c, t).agg((F.sum("padded") * c).alias("n_ents"))
    n = a.nnz()
    return ents.select(F.lit(n).cast("long").alias("nnz"), "n_ents", (F.lit(n) / F.col("n_ents")).alias("beta"))


def byte_size(a: SparseMatrix) -> int:
    """Of the chunked storage: values and 4-byte columns of all places, and the chunk arrays."""
    t = a.traits
    r = chunk_occupancy(a, t.C, t.T).first()
    return r["n_ents"] * (t.dtype.size + 4) + 8 * (-(-a.nrows // t.C) + 1) + 4 * a.nrows
