"""The library's queries over the driver's tables, and SQL for those that SQL can express.

Matrices: lineitem as (order, part) or (supplier, part) with quantities; the 1-D Laplacian on the suppliers. Vectors: whole numbers from
part, supplier and embeddings, so that sums are exact in any order.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import complex_ops as cx
from ..operators import dense, kaczmarz, permute, stats
from ..operators import distribute as dist
from ..operators.block_vector import BlockVector, reduce_parts, sync_parts
from ..operators.matrix import SparseMatrix
from ..operators.spmv import SpmvOpts, spmv
from .util import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}
WT = [[(7 * a + 3 * b) % 5 - 2 for b in range(3)] for a in range(64)]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# inputs
def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _items(s, d, row: str = "l_orderkey", rows: str = "orders") -> SparseMatrix:
    return SparseMatrix.from_df(_t(s, d, "lineitem"), row, "l_partkey", "l_quantity", _t(s, d, rows).count(), _t(s, d, "part").count())


def _part(s, d, cols=("p_size",)) -> BlockVector:
    p = _t(s, d, "part")
    return BlockVector.from_columns(p, "p_partkey", list(cols), p.count())


def _lap(s, d) -> SparseMatrix:
    return SparseMatrix.stencil(s, _t(s, d, "supplier").count(), {-1: -1.0, 0: 2.0, 1: -1.0})


def _sup(s, d, cols) -> BlockVector:
    p = _t(s, d, "supplier")
    return BlockVector.from_columns(p, "s_suppkey", cols, p.count())


def _xs(s, d) -> BlockVector:
    return _sup(s, d, [F.col("s_nationkey"), F.col("s_suppkey") % 7])


def _ys(s, d) -> BlockVector:
    return _sup(s, d, [F.col("s_suppkey") % 11, F.col("s_suppkey") % 5])


def _emb(s, d, first: int = 0, k: int = 4) -> BlockVector:
    e = _t(s, d, "embeddings")
    return BlockVector.from_columns(e, "vec_id", [F.floor(F.col("embedding")[c].cast("double") * 100) for c in range(first, first + k)], e.count())


E = "e AS (SELECT vec_id AS i, CAST(c AS INTEGER) AS c, floor(CAST(embedding[c + 1] AS DOUBLE) * 100) AS v FROM embeddings, range(4) t(c))"
E2 = "f AS (SELECT vec_id AS i, CAST(c AS INTEGER) AS c, floor(CAST(embedding[c + 5] AS DOUBLE) * 100) AS v FROM embeddings, range(4) t(c))"
E3 = "g AS (SELECT vec_id AS i, CAST(c AS INTEGER) AS c, floor(CAST(embedding[c + 9] AS DOUBLE) * 100) AS v FROM embeddings, range(4) t(c))"
E64 = "e64 AS (SELECT vec_id AS i, CAST(c AS INTEGER) AS c, floor(CAST(embedding[c + 1] AS DOUBLE) * 100) AS v FROM embeddings, range(64) t(c))"
LAP = "a AS (SELECT s_suppkey AS i, s_suppkey + o AS j, v FROM supplier, (VALUES (-1, -1e0), (0, 2e0), (1, -1e0)) t(o, v) WHERE s_suppkey + o BETWEEN 0 AND (SELECT max(s_suppkey) FROM supplier))"
XS = "x AS (SELECT s_suppkey AS i, CAST(c AS INTEGER) AS c, CAST(CASE c WHEN 0 THEN s_nationkey ELSE s_suppkey % 7 END AS DOUBLE) AS v FROM supplier, range(2) t(c))"
YS = "y AS (SELECT s_suppkey AS i, CAST(c AS INTEGER) AS c, CAST(CASE c WHEN 0 THEN s_suppkey % 11 ELSE s_suppkey % 5 END AS DOUBLE) AS v FROM supplier, range(2) t(c))"
AX = "ax AS (SELECT a.i, x.c, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY 1, 2)"
SP = "a AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem)"
P4 = lambda i: f"CAST(least(3, {i} // ((SELECT count(*) FROM supplier) // 4)) AS INTEGER)"


def _lap_sql(expr: str, more: str = "") -> str:
    return f"WITH {LAP}, {XS}, {YS}, {AX} SELECT ax.i, ax.c, {expr} AS v FROM ax JOIN x ON ax.i = x.i AND ax.c = x.c JOIN y ON ax.i = y.i AND ax.c = y.c{more}"


# products
@query("SELECT o_orderkey AS i, coalesce(sum(l_quantity * p_size), 0e0) AS y FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey GROUP BY 1")
def spmv_order_part(s, d):
    return spmv(_items(s, d), _part(s, d)).y.df.select("i", F.col("x")[0].alias("y"))


@query("SELECT s_suppkey AS i, coalesce(sum(l_quantity * p_size), 0e0) AS y FROM supplier LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_suppkey = s_suppkey GROUP BY 1")
def spmv_supp_part(s, d):
    return spmv(_items(s, d, "l_suppkey", "supplier"), _part(s, d)).y.df.select("i", F.col("x")[0].alias("y"))


@query(
    "WITH x AS (SELECT p_partkey AS j, CAST(c AS INTEGER) AS c, CAST(CASE c WHEN 0 THEN p_size WHEN 1 THEN floor(p_retailprice) ELSE 1 END AS DOUBLE) AS v FROM part, range(3) t(c)) "
    "SELECT l_suppkey AS i, c, sum(l_quantity * v) AS v FROM lineitem JOIN x ON l_partkey = j GROUP BY 1, 2"
)
def spmmv_supp_part_k3(s, d):
    return spmv(_items(s, d, "l_suppkey", "supplier"), _part(s, d, ("p_size", F.floor("p_retailprice"), F.lit(1)))).y.tidy()


@query(_lap_sql("2 * ax.v"))
def spmv_scale(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(alpha=2)).y.tidy()


@query(_lap_sql("y.v + ax.v"))
def spmv_axpy(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(axpy=True), _ys(s, d)).y.tidy()


@query(_lap_sql("3 * y.v + 2 * ax.v"))
def spmv_scale_axpby(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(alpha=2, beta=3), _ys(s, d)).y.tidy()


@query(_lap_sql("ax.v - 5 * x.v"))
def spmv_shift(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(shift=5)).y.tidy()


@query(_lap_sql("2 * (ax.v - (CASE ax.c WHEN 0 THEN 5 ELSE -3 END) * x.v)"))
def spmv_vshift(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(alpha=2, shift=[5, -3])).y.tidy()


@query(_lap_sql("4 * y.v + 3 * (2 * y.v + ax.v)"))
def spmv_chain(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(beta=2, chain=(4, 3)), _ys(s, d), _ys(s, d)).z.tidy()


@query(f"WITH {LAP}, {XS}, o AS (SELECT a.i, a.j, a.v FROM a WHERE {P4('i')} = {P4('j')}) SELECT o.i, x.c, sum(o.v * x.v) AS v FROM o JOIN x ON o.j = x.i GROUP BY 1, 2")
def spmv_nocomm(s, d):
    a = _lap(s, d)
    return spmv(a, _xs(s, d), SpmvOpts(mode="nocomm", part=dist.owner(dist.by_rows(a.nrows, 4)))).y.tidy()


@query(f"WITH {LAP}, {XS}, {YS}, {AX} SELECT ax.c, sum(ax.v * ax.v) AS yy, sum(x.v * ax.v) AS xy, sum(x.v * x.v) AS xx FROM ax JOIN x ON ax.i = x.i AND ax.c = x.c GROUP BY 1")
def spmv_dots(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(dots=True)).dots


@query(f"WITH {LAP}, {XS}, {YS}, {AX} SELECT {P4('ax.i')} AS part, ax.c, sum(ax.v * ax.v) AS yy, sum(x.v * ax.v) AS xy, sum(x.v * x.v) AS xx FROM ax JOIN x ON ax.i = x.i AND ax.c = x.c GROUP BY 1, 2")
def spmv_dots_not_reduced(s, d):
    a = _lap(s, d)
    return spmv(a, _xs(s, d), SpmvOpts(dots=True, reduce=False, part=dist.owner(dist.by_rows(a.nrows, 4)))).dots


def _split_sql(op: str, base: str) -> str:
    return f"WITH {LAP}, {XS}, {YS}, ax AS (SELECT a.i, x.c, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i WHERE {P4('a.i')} {op} {P4('a.j')} GROUP BY 1, 2) SELECT y.i, y.c, {base} + coalesce(ax.v, 0) AS v FROM y LEFT JOIN ax ON ax.i = y.i AND ax.c = y.c"


@query(_split_sql("=", "0e0"))
def spmv_local(s, d):
    a = _lap(s, d)
    return spmv(a, _xs(s, d), SpmvOpts(only="local", part=dist.owner(dist.by_rows(a.nrows, 4)))).y.tidy()


@query(_split_sql("<>", "y.v"))
def spmv_remote(s, d):
    a = _lap(s, d)
    return spmv(a, _xs(s, d), SpmvOpts(only="remote", part=dist.owner(dist.by_rows(a.nrows, 4))), _ys(s, d)).y.tidy()


@query(_lap_sql("2 * (ax.v - 5 * x.v)"))
def spmv_blocked(s, d):
    return spmv(_lap(s, d), _xs(s, d), SpmvOpts(alpha=2, shift=5, blocksz=1, mode="pipelined")).y.tidy()


@query(f"WITH {E}, m AS (SELECT i, i + o AS j, v FROM (SELECT DISTINCT i FROM e), (VALUES (-1, -1e0), (0, 2e0), (1, -1e0)) t(o, v)) SELECT p.c AS a, q.c AS b, sum(p.v * m.v * q.v) AS v FROM m JOIN e p ON m.i = p.i JOIN e q ON m.j = q.i GROUP BY 1, 2")
def vtav(s, d):
    e = _emb(s, d)
    return dense.tsmtspmtsm_df(e, SparseMatrix.stencil(s, e.nrows, {-1: -1.0, 0: 2.0, 1: -1.0}), e)


# element-wise
_EF = f"WITH {E}, {E2}, {E3} SELECT e.i, e.c, %s AS v FROM e JOIN f ON e.i = f.i AND e.c = f.c JOIN g ON e.i = g.i AND e.c = g.c"
for _name, _expr, _f in (
    ("axpy", "e.v + 2 * f.v", lambda y, x, z: y.axpy(2, x)),
    ("vaxpy", "e.v + (e.c + 1) * f.v", lambda y, x, z: y.axpy([1, 2, 3, 4], x)),
    ("axpby", "2 * f.v + 3 * e.v", lambda y, x, z: y.axpby(2, x, 3)),
    ("vaxpby", "(e.c + 1) * f.v + (2 - e.c) * e.v", lambda y, x, z: y.axpby([1, 2, 3, 4], x, [2, 1, 0, -1])),
    ("axpbypcz", "2 * f.v + 3 * e.v + 4 * g.v", lambda y, x, z: y.axpbypcz(2, x, 3, 4, z)),
    ("vaxpbypcz", "(e.c + 1) * f.v + (2 - e.c) * e.v + e.c * g.v", lambda y, x, z: y.axpbypcz([1, 2, 3, 4], x, [2, 1, 0, -1], [0, 1, 2, 3], z)),
    ("scale", "3 * e.v", lambda y, x, z: y.scale(3)),
    ("vscale", "(e.c + 1) * e.v", lambda y, x, z: y.scale([1, 2, 3, 4])),
    ("mult", "e.v * (2 * f.v)", lambda y, x, z: y.mult(2, x)),
    ("update_rows", "CASE WHEN e.i < 10 THEN f.v ELSE e.v END", lambda y, x, z: y.update_rows(x.view(0, 10, 0, 4))),
):
    QUERIES[_name] = lambda s, d, f=_f: f(_emb(s, d), _emb(s, d, 4), _emb(s, d, 8)).tidy()
    SQL[_name] = _EF % _expr


@query(f"WITH {E}, {E2} SELECT e.i, e.c, e.v * 2 * f.v AS v FROM e JOIN f ON e.i = f.i WHERE f.c = 0")
def mult1(s, d):
    return _emb(s, d).mult(2, _emb(s, d, 4, 1)).tidy()


@query(f"WITH {E}, n AS (SELECT c, sqrt(sum(v * v)) AS n FROM e GROUP BY 1) SELECT e.i, e.c, round(e.v / n.n, 9) AS v FROM e JOIN n ON e.c = n.c")
def normalize(s, d):
    return _emb(s, d).normalize().tidy().select("i", "c", F.round("v", 9).alias("v"))


# reductions
@query(f"WITH {E}, {E2} SELECT e.c, sum(e.v * f.v) AS dot FROM e JOIN f ON e.i = f.i AND e.c = f.c GROUP BY 1")
def dot(s, d):
    return _emb(s, d).dot_df(_emb(s, d, 4))


@query(f"WITH {E}, {E2} SELECT CAST(e.i % 4 AS INTEGER) AS part, e.c, sum(e.v * f.v) AS dot FROM e JOIN f ON e.i = f.i AND e.c = f.c GROUP BY 1, 2")
def localdot(s, d):
    return _emb(s, d).dot_df(_emb(s, d, 4), (F.col("i") % 4).cast("int"))


@query(f"WITH {E} SELECT c, sum(pow(v * v, 2)) AS norm FROM e GROUP BY 1")
def norm_p(s, d):
    return _emb(s, d).norm_df(2)


@query(f"WITH {E} SELECT c, round(sqrt(sum(v * v)), 9) AS nrm2 FROM e GROUP BY 1")
def nrm2(s, d):
    return _emb(s, d).norm_df(1).select("c", F.round(F.sqrt("norm"), 9).alias("nrm2"))


@query(f"WITH {E} SELECT i % 50 AS i, c, sum(v) AS v FROM e GROUP BY 1, 2")
def reduce_redundant(s, d):
    e = _emb(s, d)
    parts = e.df.select((F.col("i") / 50).cast("int").alias("part"), (F.col("i") % 50).alias("i"), "x")
    return BlockVector(reduce_parts(parts, 4), 50, 4).tidy()


@query(f"WITH {E}, q AS (SELECT i // 50 AS part, i % 50 AS i, c, v FROM e) SELECT CAST(q.part AS INTEGER) AS part, q.i, q.c, coalesce(r.v, q.v) AS v FROM q LEFT JOIN q r ON r.part = 2 AND r.i = q.i AND r.c = q.c")
def sync_values(s, d):
    e = _emb(s, d)
    parts = e.df.select(F.floor(F.col("i") / 50).cast("int").alias("part"), (F.col("i") % 50).alias("i"), "x")
    return sync_parts(parts, 2).select("part", "i", F.posexplode("x").alias("c", "v"))


@query("SELECT (SELECT count(*) FROM lineitem) AS nnz, (SELECT count(*) FROM orders) AS nrows")
def nnz_nrows(s, d):
    a = _items(s, d)
    return a.df.agg(F.count("*").alias("nnz")).select("nnz", F.lit(a.nrows).cast("long").alias("nrows"))


# dense contractions
@query(f"WITH {E64} SELECT p.c AS a, q.c AS b, sum(p.v * q.v) AS v FROM e64 p JOIN e64 q ON p.i = q.i GROUP BY 1, 2")
def gram_embeddings(s, d):
    e = _emb(s, d, 0, 64)
    return dense.gram_df(e, e)


@query(f"WITH {E}, {E2} SELECT e.c AS a, f.c AS b, sum(e.v * f.v) AS v FROM e JOIN f ON e.i = f.i GROUP BY 1, 2")
def tsmttsm(s, d):
    return dense.gram_df(_emb(s, d), _emb(s, d, 4))


@query(SQL["tsmttsm"])
def tsmttsm_kahan(s, d):
    return dense.gram_df(_emb(s, d), _emb(s, d, 4), kahan=True)


_W = "w AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST((7 * a + 3 * b) % 5 - 2 AS DOUBLE) AS w FROM range(64) t(a), range(3) u(b))"


@query(f"WITH {E64}, {_W} SELECT i, b AS c, sum(v * w) AS v FROM e64 JOIN w ON c = a GROUP BY 1, 2")
def tsmm_embeddings(s, d):
    return dense.tsmm(_emb(s, d, 0, 64), np.array(WT)).tidy()


@query(f"WITH {E}, {_W}, n AS (SELECT i, b AS c, 2 * sum(v * w) AS v FROM e JOIN w ON c = a WHERE b < 2 GROUP BY 1, 2) SELECT e.i, e.c, CASE WHEN e.c < 2 THEN n.v + 3 * e.v ELSE e.v END AS v FROM e LEFT JOIN n ON e.i = n.i AND e.c = n.c")
def tsmm_inplace(s, d):
    return dense.tsmm_inplace(_emb(s, d), np.array(WT)[:4, :2], 2, 3).tidy()


@query(f"WITH {E}, {E2}, {_W}, n AS (SELECT i, b AS c, 2 * sum(v * w) AS v FROM e JOIN w ON c = a GROUP BY 1, 2) SELECT n.i, n.c, n.v + 3 * f.v AS v FROM n JOIN f ON n.i = f.i AND n.c = f.c")
def gemm(s, d):
    return dense.gemm(_emb(s, d), np.array(WT)[:4], 2, 3, _emb(s, d, 4, 3)).tidy()


# constructors and views
@query("SELECT range AS i, CAST(c AS INTEGER) AS c, 2.5e0 AS v FROM range(100), range(3) t(c)")
def dense_from_scalar(s, d):
    return BlockVector.from_scalar(s, 100, 3, 2.5).tidy()


@query("SELECT range AS i, CAST(c AS INTEGER) AS c, CAST(range * 3 + c AS DOUBLE) AS v FROM range(100), range(3) t(c)")
def dense_from_func(s, d):
    return BlockVector.from_func(s, 100, 3, lambda i, c: i * 3 + c).tidy()


@query("SELECT CAST(c AS INTEGER) AS c, CAST(100000 AS BIGINT) AS n, true AS within, true AS mean_fits, true AS spread_fits FROM range(2) t(c)")
def dense_rand(s, d):
    """By column: how many numbers, whether all lie in [-1, 1], and whether mean and variance are those of the uniform law (0 and 1/3, within some five standard errors)."""
    x = BlockVector.rand(s, 100_000, 2, 7).tidy()
    r = x.groupBy("c").agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("most"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    return r.select("c", "n", (F.col("most") <= 1).alias("within"), (F.abs("mean") < 0.01).alias("mean_fits"), (F.abs(F.col("var") - F.lit(1 / 3)) < 0.005).alias("spread_fits"))


@query(f"WITH {LAP} SELECT i, j, v FROM a")
def sparse_from_rows(s, d):
    n = _t(s, d, "supplier").count()
    return SparseMatrix.from_rows(s, n, n, lambda i: [(j, v) for j, v in ((i - 1, -1), (i, 2), (i + 1, -1)) if 0 <= j < n]).df


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 1, 1), (2, 0, 2), (2, 2, 3)) t(i, j, v)")
def sparse_from_crs(s, d):
    return SparseMatrix.from_crs(s, [0, 1, 1, 3], [1, 0, 2], [1, 2, 3], 3).df


@query(f"WITH {E} SELECT i - 10 AS i, c - 1 AS c, v FROM e WHERE i BETWEEN 10 AND 29 AND c BETWEEN 1 AND 2")
def view_compact(s, d):
    return _emb(s, d).view(10, 20, 1, 2).tidy()


@query(f"WITH {E} SELECT i, CAST(CASE c WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS c, v FROM e WHERE c IN (0, 3)")
def view_cols_scattered(s, d):
    return _emb(s, d).columns([0, 3]).tidy()


@query(f"WITH {E} SELECT i // 7 AS i, CAST(CASE c WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS c, v FROM e WHERE c IN (1, 2) AND i % 7 = 0")
def view_scattered(s, d):
    e = _emb(s, d)
    n = -(-e.nrows // 7)
    return e.rows(s.range(n).select((F.col("id") * 7).alias("i"), F.col("id").alias("to")), n, [1, 2]).tidy()


@query(f"WITH {E} SELECT v FROM e WHERE i = 5 AND c = 2")
def entry_value(s, d):
    return _emb(s, d).entry(5, 2)


@query("SELECT l_partkey AS i, l_orderkey AS j, l_quantity AS v FROM lineitem")
def transpose(s, d):
    return _items(s, d).transpose().df


@query(f"WITH {LAP}, l AS (SELECT * FROM a WHERE j <= i) SELECT i, j, v FROM l UNION ALL SELECT j, i, v FROM l WHERE i <> j")
def symmetrize(s, d):
    a = _lap(s, d)
    return a.with_df(a.df.where("j <= i")).symmetrized().df


@query(f"WITH {SP} SELECT i, j, sum(v) AS v FROM a GROUP BY 1, 2")
def coalesce_duplicates(s, d):
    return _items(s, d, "l_suppkey", "supplier").coalesce_duplicates().df


_DF = "(SELECT i, j, v FROM a WHERE i % 3 <> 0 OR i <> j UNION ALL SELECT s_suppkey, s_suppkey, 0e0 FROM supplier WHERE s_suppkey % 3 = 0)"


@query(f"WITH {LAP} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY i <> j, j) - 1 AS INTEGER) AS pos, j, v FROM {_DF}")
def diag_first(s, d):
    a = _lap(s, d)
    return a.with_df(a.df.where("i % 3 <> 0 OR i <> j")).diag_first().select("i", "pos", "j", "v")


@query(f"WITH {SP}, b AS (SELECT i, j, sum(v) AS v FROM a GROUP BY 1, 2) SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS INTEGER) AS pos, j, v FROM b")
def sort_cols(s, d):
    return _items(s, d, "l_suppkey", "supplier").coalesce_duplicates().sorted_columns().select("i", "pos", "j", "v")


# complex
_Z = f"{E}, {E2}, z AS (SELECT e.i, e.c, e.v AS re, f.v AS im FROM e JOIN f ON e.i = f.i AND e.c = f.c)"


def _z(s, d):
    return cx.from_parts(_emb(s, d).df, _emb(s, d, 4).df)


def _flat(x):
    return x.select("i", F.posexplode("x").alias("c", "z")).select("i", "c", "z.re", "z.im")


@query(f"WITH {_Z} SELECT i, c, re, im FROM z")
def complex_from_parts(s, d):
    return _flat(_z(s, d))


@query(f"WITH {_Z} SELECT i, c, re, -im AS im FROM z")
def complex_conj(s, d):
    return _flat(cx.conj(_z(s, d)))


@query(f"WITH {_Z} SELECT i, c, 2 * re - 3 * im AS re, 3 * re + 2 * im AS im FROM z")
def complex_scale(s, d):
    return _flat(cx.scale(_z(s, d), 2 + 3j))


@query(f"WITH {_Z} SELECT c, sum(re * re + im * im) AS re, sum(re * im - im * re) AS im FROM z GROUP BY 1")
def complex_dot(s, d):
    return cx.dot(_z(s, d), _z(s, d), 4)


@query(f"WITH {_Z} SELECT i, c, im AS v FROM z")
def complex_imag(s, d):
    x = cx.parts(_z(s, d))[1]
    return x.select("i", F.posexplode("x").alias("c", "v"))


@query(f"WITH {_Z}, m AS (SELECT s_suppkey AS i, s_suppkey + o AS j, re AS mre, im AS mim FROM supplier, (VALUES (0, 1e0, 2e0), (1, -1e0, 1e0)) t(o, re, im)) SELECT m.i, z.c, sum(mre * re - mim * im) AS re, sum(mre * im + mim * re) AS im FROM m JOIN z ON m.j = z.i GROUP BY 1, 2")
def complex_spmv(s, d):
    n = _t(s, d, "supplier").count()
    arr = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.struct(F.lit(re).alias("re"), F.lit(im).alias("im")).alias("v")) for o, re, im in ((0, 1.0, 2.0), (1, -1.0, 1.0))])
    a = s.range(n).select(F.col("id").alias("i"), F.explode(arr).alias("e")).select("i", (F.col("i") + F.col("e.o")).alias("j"), "e.v")
    return _flat(cx.spmv(a, _z(s, d), 4, n))


def _unsigned(df):
    """Zeros without a sign, as products may give either."""
    return df.withColumn("re", F.col("re") + F.lit(0.0)).withColumn("im", F.col("im") + F.lit(0.0))


_Z2 = _Z + ", w AS (SELECT i, c, -im AS re, re AS im FROM z)"


@query(f"WITH {_Z2} SELECT z.i, z.c, (CASE z.c % 2 WHEN 0 THEN z.re ELSE -z.im END) + 2 * w.re + 0e0 AS re, (CASE z.c % 2 WHEN 0 THEN z.im ELSE z.re END) + 2 * w.im + 0e0 AS im FROM z JOIN w ON z.i = w.i AND z.c = w.c")
def complex_vaxpby(s, d):
    """Even columns times 1, odd ones times the imaginary unit, plus twice the vector turned by it."""
    x = _z(s, d)
    return _unsigned(_flat(cx.axpby(cx.scale(x, 1j), [1, 1j, 1, 1j], x, 2, 4)))


@query(f"WITH {_Z2} SELECT z.i, z.c, z.re * w.re - z.im * w.im + 0e0 AS re, z.re * w.im + z.im * w.re + 0e0 AS im FROM z JOIN w ON z.i = w.i AND z.c = w.c")
def complex_mult(s, d):
    x = _z(s, d)
    return _unsigned(_flat(cx.mult(cx.scale(x, 1j), x)))


@query(f"WITH {_Z2} SELECT z.i, z.c, 2 * z.re + 3 * w.re - z.re AS re, 2 * z.im + 3 * w.im - z.im AS im FROM z JOIN w ON z.i = w.i AND z.c = w.c")
def complex_axpbypcz(s, d):
    x = _z(s, d)
    return _flat(cx.axpbypcz(cx.scale(x, 1j), 2, x, 3, x, -1, 4))


@query(f"WITH {_Z} SELECT c, round(sqrt(sum(re * re + im * im)), 6) AS v FROM z GROUP BY 1")
def complex_nrm2(s, d):
    return cx.nrm2(_z(s, d), 4).withColumn("v", F.round("v", 6))


# permutations
_PERM = f"WITH {SP}, n AS (SELECT i, count(*) AS n FROM a GROUP BY 1), p AS (SELECT s_suppkey AS idx, s_suppkey // 16 * 16 + row_number() OVER (PARTITION BY s_suppkey // 16 ORDER BY coalesce(n, 0) DESC, s_suppkey) - 1 AS perm FROM supplier LEFT JOIN n ON i = s_suppkey)"


def _p(s, d):
    return permute.sort_sigma(_items(s, d, "l_suppkey", "supplier"), 16)


@query(f"{_PERM} SELECT idx, perm FROM p")
def perm_sort_sigma(s, d):
    return _p(s, d)


@query(f"{_PERM} SELECT perm AS idx, idx AS perm FROM p")
def perm_inverse(s, d):
    return permute.inverse(_p(s, d))


@query(f"{_PERM} SELECT p.idx, q.perm FROM p JOIN p q ON p.perm = q.idx")
def perm_compose(s, d):
    return permute.compose(_p(s, d), _p(s, d))


@query(f"{_PERM}, l AS (SELECT s_suppkey AS i, s_suppkey + o AS j, v FROM supplier, (VALUES (-1, -1e0), (0, 2e0), (1, -1e0)) t(o, v)) SELECT p.perm AS i, q.perm AS j, v FROM l JOIN p ON l.i = p.idx JOIN p q ON l.j = q.idx")
def perm_symmetric(s, d):
    p = _p(s, d)
    return permute.permute(_lap(s, d), p, p).df


@query(f"{_PERM} SELECT perm AS i, j, sum(v) AS v FROM a JOIN p ON i = idx GROUP BY 1, 2")
def perm_rows_only(s, d):
    return permute.permute(_items(s, d, "l_suppkey", "supplier"), _p(s, d)).coalesce_duplicates().df


@query(f"{_PERM}, {XS} SELECT perm AS i, c, v FROM x JOIN p ON i = idx")
def permute_vector(s, d):
    return permute.permute_vector(_xs(s, d), _p(s, d)).tidy()


# distribution
def _offs_df(s, offs):
    return s.createDataFrame([(k, v) for k, v in enumerate(offs)], "part int, first long")


_O = "o AS (SELECT count(*) AS n FROM orders)"
_W4 = "(VALUES (0, 0), (1, 1), (2, 3), (3, 4)) t(part, w)"


@query(f"WITH {_O} SELECT part, CAST(CASE part WHEN 0 THEN 0 WHEN 1 THEN n // 5 WHEN 2 THEN n // 5 + n * 2 // 5 WHEN 3 THEN n // 5 + n * 2 // 5 + n // 5 ELSE n END AS BIGINT) AS first FROM o, (VALUES (0), (1), (2), (3), (4)) t(part)")
def dist_rows(s, d):
    return _offs_df(s, dist.by_rows(_t(s, d, "orders").count(), 4, [1, 2, 1, 1]))


_NNZ = "r AS (SELECT o_orderkey AS i, count(l_orderkey) AS len FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), b AS (SELECT i, coalesce(sum(len) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r), g AS (SELECT count(*) // 4 + 1 AS target FROM lineitem)"


@query(f"WITH {_NNZ} SELECT part, CASE part WHEN 0 THEN 0 WHEN 4 THEN (SELECT count(*) FROM orders) ELSE (SELECT min(i) FROM b, g WHERE before >= part * target) END AS first FROM (VALUES (0), (1), (2), (3), (4)) t(part)")
def dist_nnz(s, d):
    return _offs_df(s, dist.by_nnz(_items(s, d), 4))


@query("SELECT o_orderkey AS i, CAST(least(3, o_orderkey // ((SELECT count(*) FROM orders) // 4)) AS INTEGER) AS part FROM orders")
def rank_of_row(s, d):
    n = _t(s, d, "orders").count()
    return s.range(n).select(F.col("id").alias("i"), dist.owner(dist.by_rows(n, 4))(F.col("id")).alias("part"))


_PLAN = f"{LAP}, w AS (SELECT DISTINCT {P4('i')} AS dst, {P4('j')} AS src, j FROM a WHERE {P4('i')} <> {P4('j')})"


def _plan(s, d):
    a = _lap(s, d)
    return dist.comm_plan(a, dist.by_rows(a.nrows, 4))


@query(f"WITH {_PLAN} SELECT dst, src, j FROM w")
def comm_plan(s, d):
    return _plan(s, d)


@query(f"WITH {_PLAN} SELECT dst, src, count(*) AS n FROM w GROUP BY 1, 2")
def comm_wishes(s, d):
    return dist.wishes(_plan(s, d))


@query(f"WITH {SP} SELECT j, count(*) AS n FROM a GROUP BY 1")
def ents_in_col(s, d):
    return dist.ents_in_col(_items(s, d, "l_suppkey", "supplier"))


# statistics
# by row, from its entries: distances of those left and right of the diagonal, which itself is on neither side
_PROF = """e AS (SELECT i, j, abs(j - i) AS dist, sign(j - i) AS side FROM a),
q AS (SELECT i, count(*) AS len, min(j) AS lo, max(j) AS hi, sum(dist) FILTER (WHERE side = -1) AS dl, count(*) FILTER (WHERE side = -1) AS nl,
      sum(dist) FILTER (WHERE side = 1) AS du, count(*) FILTER (WHERE side = 1) AS nu FROM e GROUP BY 1),
p AS (SELECT i, len, lo, hi, CASE WHEN nl > 0 THEN dl / nl ELSE 0 END AS al, CASE WHEN nu > 0 THEN du / nu ELSE 0 END AS au FROM q)"""


@query(f"WITH {SP}, {_PROF} SELECT i, len, lo, hi, round(al, 6) AS avg_low, round(au, 6) AS avg_up FROM p")
def row_profile(s, d):
    r = stats.row_profile(_items(s, d, "l_suppkey", "supplier"))
    return r.select("i", "len", "lo", "hi", F.round("avg_low", 6).alias("avg_low"), F.round("avg_up", 6).alias("avg_up"))


# every row counts, those of orders without lineitems too: they have no band, and 1 in the average of averages
_STATS = f"""{_PROF}, n AS (SELECT count(*) AS n, (SELECT sum(len) FROM p) AS nnz FROM rows_),
t AS (SELECT rows_.i, len, lo, hi, coalesce(al, 0) AS al, coalesce(au, 0) AS au FROM rows_ LEFT JOIN p ON rows_.i = p.i),
v AS (SELECT sum((len - nnz / n) * (len - nnz / n)) / any_value(n) AS var FROM t, n WHERE len IS NOT NULL)
SELECT CAST(any_value(nnz) AS BIGINT) AS nnz, greatest(0, max(t.i - lo)) AS lower_bandwidth, greatest(0, max(hi - t.i)) AS upper_bandwidth,
       greatest(0, max(t.i - lo)) + greatest(0, max(hi - t.i)) + 1 AS bandwidth, round(sum(coalesce(hi - lo + 1, 0)) / any_value(n), 6) AS avg_row_band,
       round(sum(al + au + 1) / any_value(n), 6) AS avg_avg_row_band, round(any_value(nnz) / any_value(n), 6) AS avg_row_len, round(any_value(var), 6) AS row_len_variance,
       round(sqrt(any_value(var)), 6) AS row_len_deviation, round(sqrt(any_value(var)) / (any_value(nnz) / any_value(n)), 6) AS row_len_cv, max(len) AS max_len FROM t, n, v"""


def _summary(a):
    r = stats.summary(a)
    rounded = ("avg_row_band", "avg_avg_row_band", "avg_row_len", "row_len_variance", "row_len_deviation", "row_len_cv")
    return r.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in r.columns])


@query(f"WITH {LAP}, rows_ AS (SELECT s_suppkey AS i FROM supplier), {_STATS}")
def mat_stats(s, d):
    return _summary(_lap(s, d))


@query(f"WITH a AS (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem), rows_ AS (SELECT o_orderkey AS i FROM orders), {_STATS}")
def mat_stats_orders(s, d):
    return _summary(_items(s, d))


@query(f"WITH {SP}, n AS (SELECT i, count(*) AS len FROM a GROUP BY 1) SELECT max(len) AS max_len, count(*) FILTER (WHERE len = (SELECT max(len) FROM n)) AS n_rows FROM n")
def longest_rows(s, d):
    return stats.longest_rows(_items(s, d, "l_suppkey", "supplier"))


@query(f"WITH {SP} SELECT j - i AS d, count(*) AS n FROM a GROUP BY 1")
def nz_dist(s, d):
    return stats.nz_dist(_items(s, d, "l_suppkey", "supplier"))


_CH = "r AS (SELECT o_orderkey AS i, count(l_orderkey) AS len FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), k AS (SELECT i // 32 AS chunk, max(len) AS chunk_len, min(len) AS chunk_min, (max(len) + 3) // 4 * 4 AS padded FROM r GROUP BY 1)"


@query(f"WITH {_CH} SELECT chunk, chunk_len, chunk_min, CAST(padded AS BIGINT) AS padded FROM k")
def chunks(s, d):
    return stats.chunks(_items(s, d), 32, 4)


@query(f"WITH {_CH} SELECT (SELECT count(*) FROM lineitem) AS nnz, CAST(sum(padded) * 32 AS BIGINT) AS n_ents, round((SELECT count(*) FROM lineitem) / (sum(padded) * 32), 9) AS beta FROM k")
def chunk_occupancy(s, d):
    return stats.chunk_occupancy(_items(s, d), 32, 4).withColumn("beta", F.round("beta", 9))


_RL = "SELECT i // {w} AS chunk, max(len) AS row_len FROM (SELECT o_orderkey AS i, count(l_orderkey) AS len FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1"


@query(_RL.format(w=2))
def row_len2(s, d):
    return stats.chunks(_items(s, d), 2).select("chunk", F.col("chunk_len").alias("row_len"))


@query(_RL.format(w=4))
def row_len4(s, d):
    return stats.chunks(_items(s, d), 4).select("chunk", F.col("chunk_len").alias("row_len"))


@query(f"WITH {LAP} SELECT count(DISTINCT i) / (max(i - j) + max(j - i)) AS ratio FROM a")
def kacz_ratio(s, d):
    return s.createDataFrame([(permute.kacz_ratio(_lap(s, d)),)], "ratio double")


_SB = "{n} AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY i) AS n FROM (SELECT i, {e} AS d FROM a WHERE {e} >= 0)), {n}m AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM {n} WHERE r = floor(n * 0.9))"


@query(f"WITH {SP}, {_SB.format(n='l', e='i - j')}, {_SB.format(n='u', e='j - i')} SELECT CAST((SELECT d FROM lm WHERE r = n // 2) + (SELECT d FROM um WHERE r = n // 2) + 1 AS BIGINT) AS band")
def smart_row_band(s, d):
    return s.createDataFrame([(stats.smart_row_band(_items(s, d, "l_suppkey", "supplier")),)], "band long")


# colours, zones, projections
_ZN = f"{LAP}, s AS (SELECT i, min(j) AS lo, max(j) AS hi FROM a GROUP BY 1), wd AS (SELECT greatest(1, (count(*) + 3) // 4) AS w FROM supplier), zn AS (SELECT i, CAST(CASE WHEN lo // w = hi // w THEN 2 * (lo // w) WHEN hi // w = lo // w + 1 THEN 2 * (lo // w) + 1 ELSE 8 END AS INTEGER) AS zone FROM s, wd)"


@query(f"WITH {_ZN} SELECT i, zone FROM zn")
def block_color_zones(s, d):
    return permute.block_zones(_lap(s, d), 4)


@query(f"WITH {_ZN} SELECT i AS idx, row_number() OVER (ORDER BY zone, i) - 1 AS perm FROM zn")
def block_color_perm(s, d):
    return permute.zone_perm(permute.block_zones(_lap(s, d), 4))


@query(f"WITH {LAP} SELECT {P4('i')} AS zone, count(DISTINCT i) AS n_rows, count(*) AS nnz, min(j) AS lo, max(j) AS hi FROM a GROUP BY 1")
def zone_report(s, d):
    a = _lap(s, d)
    return kaczmarz.zone_report(a, dist.owner(dist.by_rows(a.nrows, 4)))


@query(f"WITH {LAP}, n AS (SELECT i, sqrt(sum(v * v)) AS norm FROM a GROUP BY 1) SELECT a.i, j, round(v / norm, 9) AS v FROM a JOIN n ON a.i = n.i")
def carp_init(s, d):
    a, _, _ = kaczmarz.row_normalized(_lap(s, d))
    return a.df.select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH {XS}, p AS (SELECT i AS j, avg(v * k) AS m FROM x, (VALUES (1), (3)) t(k) WHERE c = 0 AND i % 2 = 0 GROUP BY 1) SELECT i, coalesce(m, v) AS v FROM x LEFT JOIN p ON i = j WHERE c = 0")
def halo_avg(s, d):
    x = _xs(s, d)
    parts = x.df.where("i % 2 = 0").select(F.explode(F.array(F.lit(1), F.lit(3))).alias("part"), F.col("i").alias("j"), F.col("x")[0].alias("x")).select("part", "j", (F.col("x") * F.col("part")).alias("x"))
    return kaczmarz.halo_average(parts, x).df.select("i", F.col("x")[0].alias("v"))


@query(
    f"WITH {LAP}, {XS}, {YS}, e AS (SELECT * FROM a WHERE i % 3 = 0), r AS (SELECT e.i, sum(e.v * x.v) AS ax, sum(e.v * e.v) AS nn FROM e JOIN x ON e.j = x.i AND x.c = 0 GROUP BY 1), u AS (SELECT e.j, sum((y.v - ax) / nn * e.v) AS d FROM e JOIN r ON e.i = r.i JOIN y ON y.i = r.i AND y.c = 0 GROUP BY 1) SELECT x.i, round(x.v + coalesce(d, 0), 6) AS v FROM x LEFT JOIN u ON x.i = u.j WHERE x.c = 0"
)
def kacz_color_step(s, d):
    a = _lap(s, d)
    rows = s.range(0, a.nrows, 3).select(F.col("id").alias("i"))
    return kaczmarz.color_step(a, _ys(s, d), _xs(s, d).columns([0]), rows).df.select("i", F.round(F.col("x")[0], 6).alias("v"))


@query("SELECT count(*) AS n_rows, count(*) AS n_colored, CAST(0 AS BIGINT) AS n_conflicts FROM supplier")
def color_distance2(s, d):
    """Of the colouring, how many rows have one colour, and how many columns have two entries of one colour (the SQL knows that there is none)."""
    a = _lap(s, d)
    colors = permute.color(a)
    clash = a.df.select("i", "j").distinct().join(colors, "i").groupBy("j", "color").count().where("count > 1")
    return colors.groupBy("i").count().agg(F.count("*").alias("n_rows"), F.sum((F.col("count") == 1).cast("long")).alias("n_colored")).crossJoin(clash.agg(F.count("*").alias("n_conflicts")))


@query(
    "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n_places, CAST(0 AS BIGINT) AS first, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) - 1 AS last"
)
def rcm(s, d):
    """The ordering of suppliers, then parts, linked by all of lineitem: a permutation of all rows."""
    m, n = _t(s, d, "supplier").count(), _t(s, d, "part").count()
    e = _t(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("i"), (F.col("l_partkey") + m).cast("long").alias("j"), F.col("l_quantity").cast("double").alias("v"))
    p = permute.rcm(SparseMatrix(e, m + n, m + n))
    return p.agg(F.count_distinct("idx").alias("n_rows"), F.count_distinct("perm").alias("n_places"), F.min("perm").alias("first"), F.max("perm").alias("last"))


@query("SELECT CAST(1 AS BIGINT) AS lower_bandwidth, CAST(1 AS BIGINT) AS upper_bandwidth, count(*) AS n_rows FROM supplier")
def rcm_band(s, d):
    """The tridiagonal matrix of the suppliers, scattered by a permutation, gets its bandwidths of 1 back."""
    a = _lap(s, d)
    n = a.nrows
    step = next(k for k in range(max(2, n // 3), 2 * n + 3) if math.gcd(k, n) == 1)
    p = s.range(n).select(F.col("id").alias("idx"), (F.col("id") * step % n).alias("perm"))
    mixed = permute.permute(a, p, p)
    q = permute.rcm(mixed)
    low, up = permute.bandwidths(permute.permute(mixed, q, q))
    return q.agg(F.lit(low).cast("long").alias("lower_bandwidth"), F.lit(up).cast("long").alias("upper_bandwidth"), F.count_distinct("perm").alias("n_rows"))


@query("SELECT CAST(4 AS BIGINT) AS n_parts, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cut, true AS even FROM supplier")
def graph_parts(s, d):
    """The tridiagonal matrix, scattered, in four parts by its graph: three neighbours are parted (six entries), and parts are within two rows of a quarter."""
    a = _lap(s, d)
    n = a.nrows
    step = next(k for k in range(max(2, n // 3), 2 * n + 3) if math.gcd(k, n) == 1)
    p = s.range(n).select(F.col("id").alias("idx"), (F.col("id") * step % n).alias("perm"))
    mixed = permute.permute(a, p, p)
    of = permute.graph_parts(mixed, 4)
    size = of.groupBy("part").count().agg(F.count("*").alias("n_parts"), F.sum("count").alias("n_rows"), (F.max(F.abs(F.col("count") - n / 4)) <= 2).alias("even"))
    return size.crossJoin(permute.edge_cut(mixed, of)).select("n_parts", "n_rows", "n_cut", "even")


# a sweep of the tridiagonal matrix as a recursion over rows, the vector being a list: x moves by r times the row, r being what the row misses over its squared length
_MISS = "(y[i + 1] - (2 * x[i + 1] - CASE WHEN i > 0 THEN x[i] ELSE 0 END - CASE WHEN i < n - 1 THEN x[i + 2] ELSE 0 END)) / (4 + CASE WHEN i > 0 THEN 1 ELSE 0 END + CASE WHEN i < n - 1 THEN 1 ELSE 0 END)"
_MOVED = "[x[q + 1] + CASE WHEN q = i THEN 2 * r WHEN abs(q - i) = 1 THEN -r ELSE 0 END FOR q IN range(n)]"
_LISTS = f"{XS}, {YS}, xl AS (SELECT list(v ORDER BY i) AS x FROM x WHERE c = 0), yl AS (SELECT list(v ORDER BY i) AS y, count(*) AS n FROM y WHERE c = 0)"


def _steps(name: str, start: str, order: str) -> str:
    """name(p, k, x): the vector of part p after k of the rows o that order(p, o) lists for it."""
    return f"{name}(p, k, x) AS (SELECT p, CAST(0 AS BIGINT), x FROM {start}, {order} UNION ALL SELECT p, k + 1, {_MOVED} FROM (SELECT s.p, k, x, n, o[k + 1] AS i, {_MISS} AS r FROM {name} s JOIN {order} w ON w.p = s.p, yl WHERE k < len(o)))"


def _sweep_sql(order: str) -> str:
    return f"WITH RECURSIVE {_LISTS}, w AS (SELECT 0 AS p, list(s_suppkey ORDER BY {order}) AS o FROM supplier), {_steps('st', 'xl', 'w')} SELECT CAST(q AS BIGINT) AS i, CAST(0 AS INTEGER) AS c, round(x[q + 1], 6) + 0 AS v FROM st, yl, range(n) t(q) WHERE k = n"


_MEAN = "(SELECT list(v ORDER BY q) AS x FROM (SELECT q, coalesce(avg(s.x[q + 1]) FILTER (WHERE q BETWEEN lo - 1 AND hi + 1), any_value(b.x[q + 1])) AS v FROM {st} s JOIN {w} w ON w.p = s.p AND s.k = len(o), {old} b, yl, range(n) t(q) GROUP BY q))"
_PARTS = "{n} AS (SELECT {p} AS p, list(s_suppkey ORDER BY {o}) AS o, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier GROUP BY 1)"
_CARP = (
    f"WITH RECURSIVE {_LISTS}, {_PARTS.format(n='fw', p=P4('s_suppkey'), o='s_suppkey')}, {_PARTS.format(n='bw', p=P4('s_suppkey'), o='s_suppkey DESC')}, {_steps('s1', 'xl', 'fw')}, x1 AS {_MEAN.format(st='s1', w='fw', old='xl')}, "
    f"{_steps('s2', 'x1', 'bw')}, x2 AS {_MEAN.format(st='s2', w='bw', old='x1')} SELECT CAST(q AS BIGINT) AS i, CAST(0 AS INTEGER) AS c, round(x[q + 1], 6) + 0 AS v FROM x2, yl, range(n) t(q)"
)


def _rounded(x: BlockVector):
    """Six decimals, and zeros without a sign."""
    return x.tidy().withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(_sweep_sql("s_suppkey"))
def kacz_sweep(s, d):
    return _rounded(kaczmarz.kaczmarz(_lap(s, d), _ys(s, d), _xs(s, d).columns([0])))


@query(_sweep_sql("s_suppkey DESC"))
def kacz_sweep_backward(s, d):
    return _rounded(kaczmarz.kaczmarz(_lap(s, d), _ys(s, d), _xs(s, d).columns([0]), backward=True))


# eight zones; two where so few rows would leave zones of one colour with a common column
_ZONES = "(SELECT CASE WHEN count(*) >= 32 THEN 8 ELSE 2 END FROM supplier)"
_ZONE = f"least({_ZONES} - 1, s_suppkey // ((SELECT count(*) FROM supplier) // {_ZONES}))"


@query(_sweep_sql(f"{_ZONE} % 2, s_suppkey"))
def kacz_red_black(s, d):
    a = _lap(s, d)
    return _rounded(kaczmarz.zone_sweep(a, _ys(s, d), _xs(s, d).columns([0]), dist.owner(dist.by_rows(a.nrows, 8 if a.nrows >= 32 else 2))))


_NEXT = _ZONE.replace("s_suppkey //", "least(s_suppkey + 1, (SELECT max(s_suppkey) FROM supplier)) //")


@query(_sweep_sql(f"(2 * {_ZONE} + CASE WHEN {_NEXT} > {_ZONE} THEN 1 ELSE 0 END) % 4, s_suppkey"))
def kacz_four_phases(s, d):
    """Zones parted into what stays inside and the row that leads over to the next zone."""
    a = _lap(s, d)
    four = permute.four_zones(a, dist.by_rows(a.nrows, 8 if a.nrows >= 32 else 2))
    return _rounded(kaczmarz.zone_sweep(a, _ys(s, d), _xs(s, d).columns([0]), dist.owner(four), phases=4))


@query(_sweep_sql("s_suppkey % 3, s_suppkey"))
def kacz_multi_color(s, d):
    a = _lap(s, d)
    colors = s.range(a.nrows).select(F.col("id").alias("i"), (F.col("id") % 3).cast("int").alias("color"))
    return _rounded(kaczmarz.color_sweep(a, _ys(s, d), _xs(s, d).columns([0]), colors))


_W4 = "(SELECT greatest(1, (count(*) + 3) // 4) FROM supplier)"
_LO, _HI = f"(greatest(s_suppkey - 1, 0) // {_W4})", f"(least(s_suppkey + 1, (SELECT max(s_suppkey) FROM supplier)) // {_W4})"


@query(_sweep_sql(f"CASE WHEN {_LO} = {_HI} THEN 0 WHEN {_LO} % 2 = 0 THEN 1 ELSE 2 END, s_suppkey"))
def kacz_block_multi_color(s, d):
    return _rounded(kaczmarz.block_multicolor(_lap(s, d), _ys(s, d), _xs(s, d).columns([0]), 4))


# the same recursion with A - 1/2 I: the diagonal is 3/2
_SHIFTED = _sweep_sql("s_suppkey").replace("2 * x[i + 1]", "1.5 * x[i + 1]").replace("/ (4 +", "/ (2.25 +").replace("THEN 2 * r", "THEN 1.5 * r")


@query(_SHIFTED)
def kacz_shifted_sweep(s, d):
    x = _xs(s, d).columns([0]).df.select("i", F.lit(0).alias("k"), F.col("x")[0].alias("re"), F.lit(0.0).alias("im"))
    b = _ys(s, d).df.select("i", F.col("x")[0].alias("re"), F.lit(0.0).alias("im"))
    got = kaczmarz.shifted_part_sweep(_lap(s, d), b, x, [0.5], lambda i: F.lit(0))
    return got.select("i", F.lit(0).alias("c"), (F.round("re", 6) + F.lit(0.0)).alias("v"))


@query(_CARP)
def carp_iteration(s, d):
    a = _lap(s, d)
    return _rounded(kaczmarz.carp(a, _ys(s, d), _xs(s, d).columns([0]), dist.owner(dist.by_rows(a.nrows, 4))))


# files
def _tmp(s, name: str) -> str:
    """A new place in the folder that all share."""
    at = os.path.join(shared_folder(s).removeprefix("file://").removeprefix("file:"), "files")
    os.makedirs(at, exist_ok=True)
    return os.path.join(at, f"{name}-{uuid.uuid4().hex}")


@query(f"WITH {SP} SELECT i, j, sum(v) AS v FROM a GROUP BY 1, 2")
def matrix_market_roundtrip(s, d):
    from ..sources import formats

    formats.write_mm(_items(s, d, "l_suppkey", "supplier").coalesce_duplicates(), p := _tmp(s, "mm"))
    return formats.read_mm(s, p).df


@query(f"WITH {LAP} SELECT i, j, v FROM a")
def bincrs_roundtrip(s, d):
    from ..sources import formats

    formats.write_bincrs(_lap(s, d), p := _tmp(s, "crs"))
    return formats.read_bincrs(s, p, 30).df


@query(f"WITH {E} SELECT i, c, v FROM e")
def bindense_roundtrip(s, d):
    from ..sources import formats

    formats.write_bindense(_emb(s, d), p := _tmp(s, "dense"))
    return formats.read_bindense(s, p, 100).tidy()
