"""Permutations P(idx, perm), orderings and colourings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.util import cut, global_rank, prefix_sum
from .block_vector import BlockVector
from .distribute import row_lengths
from .matrix import SparseMatrix


def sort_sigma(a: SparseMatrix, sigma: int) -> DataFrame:
    """Within windows of sigma rows by falling length, ties by row."""
    rows = row_lengths(a).withColumn("w", F.floor(F.col("i") / sigma).cast("long"))
    if sigma >= 1 << 20:  # a window too large for one task
        ranked = global_rank(rows, "w", F.desc("len"), "i", name="perm")
        return ranked.select(F.col("i").alias("idx"), "perm")
    rn = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("len"), "i")) - 1
    return rows.select(F.col("i").alias("idx"), (F.col("w") * sigma + rn).cast("long").alias("perm"))


def inverse(p: DataFrame) -> DataFrame:
    return p.select(F.col("perm").alias("idx"), F.col("idx").alias("perm"))


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    return first.withColumnRenamed("perm", "mid").join(then.withColumnRenamed("idx", "mid"), "mid").select("idx", "perm")


def permute(a: SparseMatrix, rows: DataFrame | None = None, cols: DataFrame | None = None) -> SparseMatrix:
    """Rows, columns, or both alike (symmetric) when the same P is given."""
    df = a.df
    for p, c in ((rows, "i"), (cols, "j")):
        if p is not None:
            df = df.join(p.select(F.col("idx").alias(c), "perm"), c).withColumn(c, F.col("perm")).drop("perm")
    return a.with_df(df.select("i", "j", "v"))


def permute_vector(x: BlockVector, p: DataFrame, back: bool = False) -> BlockVector:
    q = inverse(p) if back else p
    return BlockVector(x.df.join(q.withColumnRenamed("idx", "i"), "i").select(F.col("perm").alias("i"), "x"), x.nrows, x.ncols)


def bandwidths(a: SparseMatrix) -> tuple[int, int]:
    r = a.df.agg(F.max(F.col("i") - F.col("j")).alias("l"), F.max(F.col("j") - F.col("i")).alias("u")).first()
    return max(0, r["l"] or 0), max(0, r["u"] or 0)


def _pattern(a: SparseMatrix, parts: int) -> DataFrame:
    """(a, b): the symmetrised pattern without its diagonal, dealt out by a and in order there, so that joins and groups by a move no edge."""
    e = a.df.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(parts, "a").distinct().sortWithinPartitions("a", "b")


def _levels(src: np.ndarray, dst: np.ndarray, n: int, first_rows: np.ndarray | None = None) -> np.ndarray:
    """Places of the rows 0..n - 1 in Cuthill-McKee's order, from edges in both directions: level by level, by (first parent, degree, row).

    With the first row of each piece given, all pieces go on at once: places are then right within each piece only.
    """
    order = np.argsort(src, kind="stable")
    dst, degree = dst[order], np.bincount(src, minlength=n)
    first = np.cumsum(degree) - degree
    pos, at = np.full(n, -1), 0
    starts = iter(np.lexsort((np.arange(n), degree)).tolist()) if first_rows is None else None
    while at < n:
        front = first_rows if starts is None else np.array([next(i for i in starts if pos[i] < 0)])
        while len(front):
            pos[front] = np.arange(at, at + len(front))
            at += len(front)
            k = degree[front]
            to = dst[np.arange(k.sum()) + np.repeat(first[front] - (np.cumsum(k) - k), k)]
            parent = np.repeat(pos[front], k)
            new = pos[to] < 0
            to, parent = to[new], parent[new]
            front, where = np.unique(to, return_index=True)  # parents come in their order, so the first is the least
            front = front[np.lexsort((front, degree[front], parent[where]))]
    return pos


def _ranked(df: DataFrame, keys: list[str], name: str, max_local: int) -> tuple[DataFrame, int]:
    """df with 0-based ranks by long columns, and its count; at most max_local rows are ranked in one piece."""
    rows = cut(df)
    n = rows.count()
    if n > max_local:
        return global_rank(rows, *keys, name=name), n
    t = rows.toArrow()
    rank = np.empty(n, np.int64)
    rank[np.lexsort([t[k].to_numpy() for k in reversed(keys)])] = np.arange(n)
    return df.sparkSession.createDataFrame(t.append_column(name, pa.array(rank))), n


def _roots(up: DataFrame, max_local: int) -> DataFrame:
    """(a, p) with each row's least neighbour p, to (a, p) with the root that jumps over parents end at. As b is a neighbour of its parent's, no circle of parents
    is longer than two; the lesser of two is a root."""
    up = cut(up)
    if up.count() <= max_local:
        t = up.toArrow().sort_by("a")
        a = t["a"].to_numpy()
        p, at = np.searchsorted(a, t["p"].to_numpy()), np.arange(len(a))
        p = np.where((p[p] == at) & (at < p), at, p)
        while not np.array_equal(q := p[p], p):
            p = q
        return up.sparkSession.createDataFrame(pa.table({"a": a, "p": a[p]}))
    two = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
    up, moved = up.join(two, "p").select("a", F.when((F.col("q") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p")), True
    while moved:
        up = cut(up)
        up = cut(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("m")))
        moved, up = not up.where("m").isEmpty(), up.select("a", "p")
    return up


def _pieces(edges: DataFrame, max_local: int) -> DataFrame:
    """(i, root): each row of edges (a, b), in both directions, with one row that stands for its connected piece.

    Every row is joined with its least neighbour and what that one is joined with, then these groups are as rows were: each round at least halves them, and only
    the first one sees all edges.
    """
    links, of = edges, None
    while of is None or not links.isEmpty():
        up = _roots(links.groupBy("a").agg(F.min("b").alias("p")), max_local)
        if of is None:
            of = up.select(F.col("a").alias("i"), F.col("p").alias("root"))
        else:
            of = cut(of.join(up.select(F.col("a").alias("root"), "p"), "root", "left").select("i", F.coalesce("p", "root").alias("root")))
        half = links.where("a < b").join(up.withColumnRenamed("p", "pa"), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        half = half.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        links = cut(half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return of


def _by_levels(edges: DataFrame, nodes: DataFrame, starts: DataFrame, total: int, max_local: int, max_levels: int | None = None) -> tuple[DataFrame, bool]:
    """(i, pos): places of the rows that starts reach, total at most, and whether none is left after max_levels. Places are right within each connected piece.

    A few jobs a level for all pieces at once. Edges are not moved where a level's rows can be broadcast; else only those of rows without a place are.
    """
    last, front = None, cut(starts.select("i", F.lit(0).cast("long").alias("pos")))
    done, size = front, front.count()
    n, levels = size, 0
    while size and n < total:
        if max_levels is not None and levels >= max_levels:
            return done, False
        levels += 1
        to, of = front.select(F.col("i").alias("b"), "pos"), edges
        if size <= min(max_local, 1_000_000):
            to = F.broadcast(to)
        else:
            rest = nodes.join(done, "i", "left_anti").select(F.col("i").alias("a"))
            of = edges.join(F.broadcast(rest) if total - n <= min(max_local, 1_000_000) else rest, "a", "left_semi")
        seen = front.select("i") if last is None else front.select("i").unionAll(last.select("i"))
        nxt = of.join(to, "b").groupBy(F.col("a").alias("i")).agg(F.min("pos").alias("p")).join(seen, "i", "left_anti").join(nodes.select("i", "d"), "i")
        ranked, size = _ranked(nxt, ["p", "d", "i"], "rank", max_local)
        last, front = front, ranked.select("i", (F.col("rank") + n).alias("pos"))
        if size > max_local:
            front = cut(front)
        n, done = n + size, done.unionAll(front)
        if levels % 16 == 0:
            done = cut(done)
    return done, True


def _in_tasks(edges: DataFrame, nodes: DataFrame, pieces: DataFrame, max_local: int) -> DataFrame:
    """(i, pos): places within pieces of at most max_local edges. A task takes pieces of less than twice as many edges together, and all of them at once."""
    ranked, n = _ranked(pieces, ["sd", "si"], "k", max_local)
    bins = prefix_sum(cut(ranked), "k", "e", "before", n).select("root", F.floor(F.col("before") / max(1, max_local)).cast("long").alias("bin"))
    own = nodes.join(bins, "root").select(F.col("i").alias("a"), "bin", (F.col("si") == F.col("i")).alias("first"))

    def run(t: pa.Table) -> pa.Table:
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        ids = np.unique(a)
        src = np.searchsorted(ids, a)
        first = np.unique(src[t["first"].to_numpy()])
        return pa.table({"i": ids, "pos": _levels(src, np.searchsorted(ids, b), len(ids), first)})

    return edges.join(own, "a").groupBy("bin").applyInArrow(run, "i long, pos long")


def rcm(a: SparseMatrix, max_levels: int | None = None, max_local: int = 2_000_000) -> DataFrame:
    """Reverse Cuthill-McKee on the symmetrised pattern: levels from a row of least degree, each by (first parent, degree, row).

    Patterns of at most max_local edges and rows (counted before) are ordered in one piece. Larger ones that are connected and have few levels take a few jobs a
    level. Otherwise connected pieces are found first, as each is ordered by itself and they follow each other by their first rows' (degree, row): pieces of at
    most max_local edges are ordered within tasks, many at once, and the others by levels, all of them together. All rows are ordered; a bound on the levels
    raises when it is hit, and has all pieces go by levels.
    """
    if a.nrows != a.ncols:
        raise ValueError("this ordering needs a square matrix")
    spark = a.df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    edges = _pattern(a, parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if max_levels is None and max(a.nrows, edges.count()) <= max_local:
            e = edges.toArrow()
            pos = _levels(e["a"].to_numpy(), e["b"].to_numpy(), a.nrows)
            return spark.createDataFrame(pa.table({"idx": np.arange(a.nrows), "perm": a.nrows - 1 - pos}))
        zero = F.lit(0).cast("long")
        nodes = cut(edges.groupBy(F.col("a").alias("i")).agg(F.count("*").alias("d")))
        rows = spark.range(a.nrows).select(F.col("id").alias("i")).join(nodes, "i", "left_anti").select("i", zero.alias("pos"), zero.alias("sd"), F.col("i").alias("si"))
        total = nodes.count()
        placed, whole = _by_levels(edges, nodes, nodes.orderBy("d", "i").limit(1), total, max_local, 16 if max_levels is None else min(16, max_levels))
        if not whole and max_levels is not None and max_levels <= 16:
            raise RuntimeError("too many levels")
        if whole and placed.count() == total:
            rows = rows.unionAll(placed.select("i", "pos", F.lit(1).cast("long").alias("sd"), zero.alias("si")))
        else:
            nodes = nodes.join(_pieces(edges, max_local), "i")
            pieces = nodes.groupBy("root").agg(F.min(F.struct("d", "i")).alias("s"), F.sum("d").alias("e"), F.count("*").alias("n"))
            pieces = cut(pieces.select("root", F.col("s.d").alias("sd"), F.col("s.i").alias("si"), "e", "n"))
            nodes = cut(nodes.join(pieces.select("root", "sd", "si", "e"), "root"))
            small = F.col("e") <= (max_local if max_levels is None else 0)
            large = pieces.where(~small).agg(F.sum("n")).first()[0] or 0
            placed = []
            if large < total:
                placed.append(_in_tasks(edges, nodes.where(small), pieces.where(small), max_local))
            if large:
                got, whole = _by_levels(edges, nodes.where(~small), pieces.where(~small).select(F.col("si").alias("i")), large, max_local, max_levels)
                if not whole:
                    raise RuntimeError("too many levels")
                placed.append(got)
            for p in placed:
                rows = rows.unionAll(p.join(nodes.select("i", "sd", "si"), "i").select("i", "pos", "sd", "si"))
        return _ranked(rows, ["sd", "si", "pos"], "rank", max_local)[0].select(F.col("i").alias("idx"), (F.lit(a.nrows - 1) - F.col("rank")).alias("perm"))
    finally:
        edges.unpersist()


def rcm_bipartite(a: SparseMatrix, **kw) -> tuple[DataFrame, DataFrame]:
    """For unsymmetric patterns: rows and columns are the two sides of one graph, which is ordered as a whole; of that order each side takes its own."""
    n = a.nrows
    both = SparseMatrix(a.df.select("i", (F.col("j") + n).alias("j"), "v"), n + a.ncols, n + a.ncols)
    p = cut(rcm(both, **kw))
    side = lambda df, off: global_rank(df, "perm", name="rank").select((F.col("idx") - off).alias("idx"), F.col("rank").alias("perm"))
    return side(p.where(F.col("idx") < n), 0), side(p.where(F.col("idx") >= n), n)


def color(a: SparseMatrix, max_rounds: int = 1000) -> DataFrame:
    """(i, color): no two rows of a colour share a column. Rounds of independent rows: the row of least (hash, i) in each of its columns takes the round's colour.

    Conflicts are found by a minimum per column, not by pairs of rows, so a full column costs its entries alone.
    """
    e = cut(a.df.select("i", "j").distinct())
    space = a.df.sparkSession.range(a.nrows).select(F.col("id").alias("i"))
    out = space.join(e.select("i").distinct(), "i", "left_anti").select("i", F.lit(0).alias("color"))
    left, c = e, 0
    while not left.isEmpty():
        if c >= max_rounds:
            raise RuntimeError("too many colours")
        pri = F.struct(F.xxhash64("i", F.lit(c)).alias("h"), "i")
        first = left.groupBy("j").agg(F.min(pri).alias("m"))
        won = left.join(first, "j").groupBy("i").agg(F.min((F.col("m.i") == F.col("i")).cast("int")).alias("w")).where("w = 1").select("i")
        won = cut(won)
        out = out.unionAll(won.select("i", F.lit(c).alias("color")))
        left = cut(left.join(won, "i", "left_anti"))
        c += 1
    return out


def color_perm(colors: DataFrame) -> DataFrame:
    """Rows by colour, then by row."""
    return global_rank(colors, "color", "i", name="perm").select(F.col("i").alias("idx"), "perm")


def graph_parts(a: SparseMatrix, parts: int, **kw) -> DataFrame:
    """(i, part): a partition of the rows by the graph of the symmetrised pattern: along a breadth-first order (rcm), which keeps neighbours near, into parts that are even in entries."""
    order_ = cut(rcm(a, **kw))
    rows = row_lengths(a).join(order_.withColumnRenamed("idx", "i"), "i").select("perm", "i", (F.col("len") + 1).alias("w"))  # a row without entries counts too
    before = cut(prefix_sum(rows, "perm", "w", "before", a.nrows))
    total = before.agg(F.sum("w")).first()[0] or 1
    return before.select("i", F.least(F.lit(parts - 1), F.floor(F.col("before") * parts / total)).cast("int").alias("part"))


def edge_cut(a: SparseMatrix, of: DataFrame) -> DataFrame:
    """(n_cut): entries whose row and column lie in two parts of of(i, part)."""
    e = a.df.join(of, "i").join(of.select(F.col("i").alias("j"), F.col("part").alias("other")), "j")
    return e.agg(F.coalesce(F.sum((F.col("part") != F.col("other")).cast("long")), F.lit(0)).alias("n_cut"))


def parts_perm(of: DataFrame) -> DataFrame:
    """Rows by part, then by row."""
    return global_rank(of, "part", "i", name="perm").select(F.col("i").alias("idx"), "perm")


def kacz_ratio(a: SparseMatrix) -> float:
    """Rows over bandwidth (lower plus upper): about how many zones of two colours find room. Block multi-colours are for matrices whose ratio is below the tasks that are to run."""
    width = sum(bandwidths(a))
    return a.nrows / width if width else float("inf")


def block_zones(a: SparseMatrix, zones: int) -> DataFrame:
    """(i, zone): rows within one slice of columns are its pure zone 2 s, rows over two neighbours the transition 2 s + 1, others the rest 2 zones."""
    g = a.df.groupBy("i").agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    width = max(1, -(-a.ncols // zones))
    s, t = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    zone = F.when(s == t, 2 * s).when(t == s + 1, 2 * s + 1).otherwise(F.lit(2 * zones))
    return g.select("i", zone.cast("int").alias("zone"))


def zone_perm(z: DataFrame) -> DataFrame:
    return global_rank(z, "zone", "i", name="perm").select(F.col("i").alias("idx"), "perm")


def dissect(a: SparseMatrix, threads: int) -> list[int]:
    """First rows of 2 * threads zones, each as high as the bandwidth and even in entries; fewer threads if there isn't room."""
    from .distribute import by_nnz

    low, up = bandwidths(a)
    for t in range(threads, 0, -1):
        offs = by_nnz(a, 2 * t)
        if t == 1 or min(b - x for x, b in zip(offs, offs[1:], strict=False)) >= low + up:
            return offs
    return [0, a.nrows]


def four_zones(a: SparseMatrix, offs: list[int]) -> list[int]:
    """Zones of two colours, each parted at its first row that reaches columns of the next zone: what stays inside, then what leads over. For sweeps in four phases."""
    from .distribute import owner

    ends = F.array(*[F.lit(o).cast("long") for o in offs[1:]])
    reach = a.df.groupBy("i").agg(F.max("j").alias("hi")).withColumn("z", owner(offs)(F.col("i")))
    first = {r["z"]: r["at"] for r in reach.where(F.col("hi") >= F.get(ends, F.col("z"))).groupBy("z").agg(F.min("i").alias("at")).collect()}  # a row a zone
    out = [offs[0]]
    for z, (lo, hi) in enumerate(zip(offs, offs[1:], strict=False)):
        out += [max(lo, min(hi, first.get(z, hi))), hi]
    return out


def zones_disjoint(a: SparseMatrix, offs: list[int], phases: int = 2) -> bool:
    """Whether zones of one phase share no column."""
    from .distribute import owner

    z = owner(offs)(F.col("i"))
    spans = {r["z"]: (r["lo"], r["hi"]) for r in a.df.groupBy(z.alias("z")).agg(F.min("j").alias("lo"), F.max("j").alias("hi")).collect()}
    ks = sorted(spans)
    return all(spans[k][1] < spans[m][0] for k in ks for m in ks if m > k and (m - k) % phases == 0)


def match_permutation(x: BlockVector, have: DataFrame | None, want: DataFrame | None) -> BlockVector:
    """x, whose rows were permuted by have, in the order of want: what an operand needs beside a matrix that is permuted otherwise. None is no permutation."""
    if have is want:
        return x
    if have is not None:
        x = permute_vector(x, have, back=True)
    return x if want is None else permute_vector(x, want)


def order(a: SparseMatrix, names: list[str], **kw) -> DataFrame:
    """A chain of orderings in the given order: parts (a partition by the graph), rcm, color, block, sort; any callable is an ordering of one's own."""
    own = {"rcm": rcm, "parts": lambda m: parts_perm(graph_parts(m, kw.get("parts", 4))), "color": lambda m: color_perm(color(m)), "block": lambda m: zone_perm(block_zones(m, kw.get("zones", 4))), "sort": lambda m: sort_sigma(m, kw.get("sigma", 32))}
    total, cur = None, a
    for n in names:
        p = cut((n if callable(n) else own[n])(cur))
        total = p if total is None else cut(compose(total, p))
        cur = permute(cur, p, p)
    return total
