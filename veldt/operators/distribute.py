"""Distribution of rows over parts, and the communication that a distribution implies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.util import prefix_sum
from .matrix import SparseMatrix


def by_rows(n: int, parts: int, weights: list[float] | None = None) -> list[int]:
    """First rows of the parts, and n: shares floor(n w / sum w), the last part takes the rest."""
    w = weights or [1.0] * parts
    offs = [0]
    for k in range(parts - 1):
        offs.append(offs[-1] + int(n * w[k] / sum(w)))
    return [*offs, n]


def explicit(rows: list[int]) -> list[int]:
    offs = [0]
    for r in rows:
        offs.append(offs[-1] + r)
    return offs


def row_lengths(a: SparseMatrix) -> DataFrame:
    """(i, len) of every row, the empty ones too."""
    have = a.df.groupBy("i").agg(F.count("*").alias("n"))
    return a.df.sparkSession.range(a.nrows).select(F.col("id").alias("i")).join(have, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("len"))


def by_nnz(a: SparseMatrix, parts: int) -> list[int]:
    """First rows of the parts: part k begins at the first row with k * (nnz / parts + 1) entries or more before it."""
    rows = prefix_sum(row_lengths(a), "i", "len", "before", a.nrows)
    target = a.nnz() // parts + 1
    marks = rows.agg(*[F.min(F.when(F.col("before") >= k * target, F.col("i"))).alias(f"p{k}") for k in range(1, parts)]).first() if parts > 1 else []
    return [0, *[a.nrows if m is None else m for m in marks], a.nrows]


def owner(offs: list[int]) -> Callable[[Column], Column]:
    """The part of a row: few parts are a chain of comparisons; many a binary search in one constant array, whose code doesn't grow with them."""
    n = len(offs) - 1

    def part(i: Column) -> Column:
        if n <= 16:
            out = F.lit(n - 1)
            for k in range(n - 2, -1, -1):
                out = F.when(i < offs[k + 1], F.lit(k)).otherwise(out)
            return out
        ends = F.array(*[F.lit(o).cast("long") for o in offs[1:]])
        span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

        def halve(a, _):
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            below = i < F.get(ends, mid)  # the first part whose end is beyond i
            return F.when(a["lo"] >= a["hi"], a).when(below, span(a["lo"], mid)).otherwise(span(mid + 1, a["hi"]))

        return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), span(F.lit(0), F.lit(n - 1)), halve)["lo"]

    return part


def comm_plan(a: SparseMatrix, offs: list[int]) -> DataFrame:
    """(dst, src, j): columns that dst needs of src."""
    part = owner(offs)
    return a.df.select(part(F.col("i")).alias("dst"), part(F.col("j")).alias("src"), "j").where("dst <> src").distinct()


def wishes(plan: DataFrame) -> DataFrame:
    """(dst, src, n): n is dst's wish of src and src's due to dst."""
    return plan.groupBy("dst", "src").agg(F.count("*").alias("n"))


def comm_string(plan: DataFrame, parts: int) -> str:
    """A table of what each part gets and sends; parts are few."""
    n = {(r["dst"], r["src"]): r["n"] for r in wishes(plan).collect()}
    line = lambda p: f"{p:>6} | " + " ".join(f"{n.get((q, p), 0):>8}" for q in range(parts)) + " | " + " ".join(f"{n.get((p, q), 0):>8}" for q in range(parts))
    return "\n".join(["  part | dues to each | wishes of each", *map(line, range(parts))])


def ents_in_col(a: SparseMatrix) -> DataFrame:
    return a.df.groupBy("j").agg(F.count("*").alias("n"))


@dataclass
class Context:
    """Index spaces of a matrix and what is known of them."""

    nrows: int
    ncols: int
    row_offs: list[int] = field(default_factory=list)
    col_offs: list[int] = field(default_factory=list)
    row_perm: DataFrame | None = None
    col_perm: DataFrame | None = None

    def __post_init__(self) -> None:
        self.row_offs = self.row_offs or [0, self.nrows]
        self.col_offs = self.col_offs or ([*self.row_offs] if self.nrows == self.ncols else [0, self.ncols])
        for offs, n in ((self.row_offs, self.nrows), (self.col_offs, self.ncols)):
            if offs[0] or offs[-1] != n or any(b < a for a, b in zip(offs, offs[1:], strict=False)):
                raise ValueError("a distribution must cover its index space in order")

    def set_map(self, row_offs: list[int]) -> Context:
        return Context(self.nrows, self.ncols, row_offs, None or [], self.row_perm, self.col_perm)

    def accepts(self, other: Context) -> bool:
        """Whether a matrix of the other context may share this one's columns."""
        return other.ncols == self.ncols and other.col_offs == self.col_offs

    def __str__(self) -> str:
        return f"{self.nrows} x {self.ncols}, rows from {self.row_offs[:-1]}, columns from {self.col_offs[:-1]}"
