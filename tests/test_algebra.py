"""What SQL can't express, against numpy; invariants; small fixed matrices."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.operators import complex_ops, dense, kaczmarz, permute, stats
from veldt.operators import distribute as dist
from veldt.operators.block_vector import BlockVector
from veldt.operators.matrix import SparseMatrix
from veldt.operators.spmv import SpmvOpts, spmv
from veldt.plans import errors, timing, util
from veldt.plans.dtypes import DType
from veldt.sources import formats

RNG = np.random.default_rng(4)


def sparse(spark, a):
    i, j = np.nonzero(a)
    return SparseMatrix(spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double"), *a.shape)


def vec(spark, x):
    return BlockVector.from_numpy(spark, x)


def random_sparse(n, m, fill=0.1):
    return np.where(RNG.random((n, m)) < fill, RNG.normal(size=(n, m)), 0.0)


@pytest.fixture(scope="module")
def band(spark):
    n = 40
    a = SparseMatrix.stencil(spark, n, {-1: -1.0, 0: 2.5, 1: -1.0})
    return a, a.to_numpy()


# fixed matrices
def test_diagonal(spark):
    a = SparseMatrix.from_rows(spark, 4, 4, lambda r: [(r, r + 1)])
    x = np.arange(1, 5.0)
    assert np.array_equal(spmv(a, vec(spark, x)).y.to_numpy()[:, 0], (np.arange(4) + 1) * x)


@pytest.mark.parametrize("drop, first", [(False, 10.9), (True, 6.5)])
def test_arrow(spark, drop, first):
    rows = [(0, 1.0), (1, 2.2), (2, 3.3), (3, 4.4)]
    a = SparseMatrix.from_rows(spark, 4, 4, lambda r: rows[: 3 if drop else 4] if r == 0 else [(r, r + 1)])
    assert np.allclose(spmv(a, BlockVector.from_scalar(spark, 4, 1, 1)).y.to_numpy()[:, 0], [first, 2, 3, 4], rtol=0, atol=1e-14)


def test_diagonal_first(spark):
    e = [(0, 0, 1.0), (0, 2, 1.1), (1, 0, 2.1), (1, 1, 2.0), (1, 3, 2.2), (2, 1, 3.1), (3, 1, 4.1), (3, 2, 4.2), (3, 3, 4.0)]
    a = SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), 4, 4)
    heads = {r["i"]: (r["j"], r["v"]) for r in a.diag_first().where("pos = 0").collect()}
    assert heads == {0: (0, 1.0), 1: (1, 2.0), 2: (2, 0.0), 3: (3, 4.0)}


def test_communication(spark):
    cols = {0: [0, 1, 3, 4], 1: [1, 2, 3], 2: [0, 1, 5], 3: [1, 2, 3], 4: [4, 5], 5: [0, 4, 5]}
    a = SparseMatrix.from_rows(spark, 6, 6, lambda r: [(c, 1) for c in cols[r]])
    plan = dist.comm_plan(a, [0, 2, 4, 6])
    assert {(r["dst"], r["src"], r["j"]) for r in plan.collect()} == {(0, 1, 2), (0, 1, 3), (0, 2, 4), (1, 0, 0), (1, 0, 1), (1, 2, 5), (2, 0, 0)}
    assert "2" in dist.comm_string(plan, 3)


def test_contexts():
    assert dist.Context(4, 4).row_offs == [0, 4]
    assert dist.Context(4, 4, [0, 1, 4], [0, 1, 4]).accepts(dist.Context(4, 4, [0, 1, 4]))
    assert not dist.Context(4, 4, [0, 1, 4]).accepts(dist.Context(4, 5))
    with pytest.raises(ValueError):
        dist.Context(4, 4, [0, 5, 4])


# products
def test_product_with_all_options(spark):
    n, k = 30, 3
    a, x, y, z = random_sparse(n, n), RNG.normal(size=(n, k)), RNG.normal(size=(n, k)), RNG.normal(size=(n, k))
    r = spmv(sparse(spark, a), vec(spark, x), SpmvOpts(alpha=2, beta=3, shift=[1, 2, 3], chain=(4, 5), dots=True), vec(spark, y), vec(spark, z))
    want = 2 * (a @ x - x * [1, 2, 3]) + 3 * y
    assert np.allclose(r.y.to_numpy(), want) and np.allclose(r.z.to_numpy(), 4 * z + 5 * want)
    got = {d["c"]: (d["yy"], d["xy"], d["xx"]) for d in r.dots.collect()}
    for c in range(k):
        assert np.allclose(got[c], (want[:, c] @ want[:, c], x[:, c] @ want[:, c], x[:, c] @ x[:, c]))


def test_local_and_remote_make_the_whole(spark, band):
    a, m = band
    x = RNG.normal(size=(40, 2))
    part = dist.owner(dist.by_rows(40, 4))
    y = spmv(a, vec(spark, x), SpmvOpts(only="local", part=part)).y
    assert np.allclose(spmv(a, vec(spark, x), SpmvOpts(only="remote", part=part), y).y.to_numpy(), m @ x)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6), st.integers(-9, 9)), max_size=20))
def test_repeated_entries_add_up(spark, entries):
    m = np.zeros((6, 7))
    for i, j, v in entries:
        m[i, j] += v
    a = SparseMatrix(spark.createDataFrame([(i, j, float(v)) for i, j, v in entries], "i long, j long, v double"), 6, 7)
    x = np.arange(7.0)
    assert np.array_equal(spmv(a, vec(spark, x)).y.to_numpy()[:, 0], m @ x)


def test_dense_products(spark):
    v, w = RNG.normal(size=(50, 20)), RNG.normal(size=(50, 18))
    a = random_sparse(50, 50)
    assert np.allclose(dense.tsmttsm(vec(spark, v), vec(spark, w), 2, 1, np.ones((20, 18))), 2 * v.T @ w + 1)
    small = RNG.normal(size=(20, 18))
    assert np.allclose(dense.gemm(vec(spark, v), small).to_numpy(), v @ small)
    assert np.allclose(dense.gemm(vec(spark, v), small.T, trans_w="T").to_numpy(), v @ small)
    got = {(r["a"], r["b"]): r["v"] for r in dense.tsmtspmtsm_df(vec(spark, v[:, :3]), sparse(spark, a), vec(spark, w[:, :2])).collect()}
    assert np.allclose([[got[i, j] for j in range(2)] for i in range(3)], v[:, :3].T @ a @ w[:, :2])


def test_dense_products_of_all_pairs(spark):
    v, w, small = RNG.normal(size=(30, 3)), RNG.normal(size=(30, 2)), RNG.normal(size=(4, 3))
    tall = vec(spark, v)
    assert np.allclose(dense.gemm(small, tall, 2.0, trans_w="T").to_numpy(), 2 * (small @ v.T).T)  # wide, so given as its transpose
    assert np.allclose(dense.gemm(tall, w, trans_v="T"), v.T @ w) and np.allclose(dense.gemm(tall, w.T, trans_v="C", trans_w="T"), v.T @ w)
    assert np.allclose(dense.gemm(w.T, tall), w.T @ v) and np.allclose(dense.gemm(w, tall, 1.0, 2.0, np.ones((2, 3)), trans_v="T"), w.T @ v + 2)
    assert np.allclose(dense.gemm(small, v.T, trans_v="N"), small @ v.T)
    for bad in ({"trans_w": "T"}, {"trans_v": "X"}):
        with pytest.raises(ValueError):
            dense.gemm(tall, vec(spark, w), **bad)
    a = random_sparse(30, 30)
    assert np.allclose(dense.tsmtspmtsm(tall, sparse(spark, a), vec(spark, w), 3.0, 2.0, np.ones((3, 2))), 3 * v.T @ a @ w + 2)


def test_compensated_sums(spark):
    x = np.array([[1e16], [1.0], [-1e16], [1.0]] * 50)
    assert dense.tsmttsm(vec(spark, x), vec(spark, np.ones((200, 1))), kahan=True)[0, 0] == 100.0
    hard = RNG.normal(size=(501, 3)) * 10.0 ** RNG.integers(-8, 17, (501, 3))
    hard = np.concatenate([hard, -hard, np.ones((1, 3))])
    assert np.allclose(dense.tsmttsm(vec(spark, hard), vec(spark, np.ones((1003, 1))), kahan=True), 1.0, rtol=1e-12)


def test_owners_of_many_parts(spark):
    offs = [0, *sorted(RNG.integers(0, 500, 99).tolist()), 500]  # some parts are empty
    for o in (offs, [0, 500], [0, 250, 500]):
        got = {r["id"]: r["p"] for r in spark.range(500).select("id", dist.owner(o)(F.col("id")).alias("p")).collect()}
        assert got == {i: int(np.searchsorted(o[1:-1], i, "right")) for i in range(500)}


def test_no_communication_sees_own_columns(spark, band):
    a, m = band
    x, part = RNG.normal(size=(40, 2)), dist.owner(dist.by_rows(40, 4))
    own = np.kron(np.eye(4), np.ones((10, 10))) * m
    assert np.allclose(spmv(a, vec(spark, x), SpmvOpts(mode="nocomm", part=part)).y.to_numpy(), own @ x)
    assert np.allclose(spmv(a, vec(spark, x), SpmvOpts(mode="pipelined", part=part)).y.to_numpy(), m @ x)
    with pytest.raises(ValueError):
        spmv(a, vec(spark, x), SpmvOpts(mode="vectr"))
    r = spmv(a, vec(spark, x), SpmvOpts(dots=True))
    r.dots.collect()
    r.release()


def test_average_bands_leave_the_diagonal_out(spark):
    """Of the 5-row Laplacian: rows with two neighbours have 1 + 1 + 1, those at the ends 1 + 1; with three empty rows below, each adds 1."""
    lap = SparseMatrix.stencil(spark, 5, {-1: -1.0, 0: 2.0, 1: -1.0})
    r = stats.summary(lap).first()
    assert r["avg_avg_row_band"] == pytest.approx((3 * 3 + 2 * 2) / 5) and r["avg_row_band"] == pytest.approx((3 * 3 + 2 * 2) / 5)
    r = stats.summary(SparseMatrix(lap.df, 8, 8)).first()
    assert r["avg_avg_row_band"] == pytest.approx((13 + 3) / 8) and r["avg_row_band"] == pytest.approx(13 / 8)


# permutations
def test_permutations_undo(spark, band):
    a, m = band
    p = permute.sort_sigma(sparse(spark, random_sparse(40, 40, 0.3)), 16)
    to = {r["idx"]: r["perm"] for r in p.collect()}
    assert sorted(to.values()) == list(range(40))
    b = permute.permute(a, p, p).to_numpy()
    order = np.argsort([to[i] for i in range(40)])
    assert np.allclose(b, m[np.ix_(order, order)])
    x = vec(spark, RNG.normal(size=(40, 2)))
    assert np.array_equal(permute.permute_vector(permute.permute_vector(x, p), p, back=True).to_numpy(), x.to_numpy())


def test_rcm_narrows_the_band(spark):
    n = 36
    shuffled = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 7 % n).alias("perm"))
    a = permute.permute(SparseMatrix.stencil(spark, n, {-6: 1.0, -1: 1.0, 0: 4.0, 1: 1.0, 6: 1.0}), shuffled, shuffled)
    p = permute.rcm(a)
    assert sorted(r["perm"] for r in p.collect()) == list(range(n))
    before, after = sum(permute.bandwidths(a)), sum(permute.bandwidths(permute.permute(a, p, p)))
    assert after < before


@pytest.mark.parametrize("max_local", [2_000_000, 0])
def test_rcm_orders_every_row(spark, max_local):
    """Twenty thousand rows without neighbours and more, two pieces; a bound on the levels raises."""
    n = 20_050
    a = SparseMatrix(spark.createDataFrame([(3, 4, 1.0), (4, 5, 1.0), (9, 10, 1.0), (8, 8, 1.0)], "i long, j long, v double"), n, n)
    at = {r["idx"]: r["perm"] for r in permute.rcm(a, max_local=max_local).collect()}
    linked = [3, 4, 5, 9, 10]
    want = [i for i in range(n) if i not in linked] + [3, 4, 5, 9, 10]
    assert at == {i: n - 1 - k for k, i in enumerate(want)}
    with pytest.raises(RuntimeError):
        permute.rcm(SparseMatrix.stencil(spark, 6, {-1: 1.0, 1: 1.0}), max_levels=2)


def test_rcm_is_the_same_in_one_piece_and_by_levels(spark):
    a = sparse(spark, np.triu(random_sparse(60, 60, 0.04)))
    by_levels = {r["idx"]: r["perm"] for r in permute.rcm(a, max_local=0).collect()}
    assert by_levels == {r["idx"]: r["perm"] for r in permute.rcm(a).collect()} and sorted(by_levels.values()) == list(range(60))


@pytest.mark.parametrize("max_local", [6, 40])
def test_rcm_is_the_same_by_pieces(spark, max_local):
    """Pieces within tasks beside a large one by levels, rows without neighbours, and a path that has more levels than are tried before pieces are looked for."""
    n = 90
    ring = [(i, (i + 1) % 25) for i in range(25)]
    linked = [*ring, *[(int(i), int(j)) for i, j in RNG.integers(25, 60, (22, 2))], *[(i, i + 1) for i in range(60, 84)]]
    mixed = RNG.permutation(n)
    a = SparseMatrix(spark.createDataFrame([(int(mixed[i]), int(mixed[j]), 1.0) for i, j in linked], "i long, j long, v double"), n, n)
    want = {r["idx"]: r["perm"] for r in permute.rcm(a).collect()}
    assert {r["idx"]: r["perm"] for r in permute.rcm(a, max_local=max_local).collect()} == want and sorted(want.values()) == list(range(n))


def test_rcm_takes_no_jobs_a_piece(spark):
    """Sixteen times as many pieces of one kind take hardly more jobs."""

    def jobs(pieces):
        a = SparseMatrix(spark.createDataFrame([(3 * k + i, 3 * k + i + 1, 1.0) for k in range(pieces) for i in range(2)], "i long, j long, v double"), 3 * pieces, 3 * pieces)
        spark.sparkContext.setJobGroup(group := f"rcm of {pieces}", "")
        try:
            assert permute.rcm(a, max_local=2).count() == 3 * pieces
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = jobs(3)
    assert few and jobs(48) <= 1.5 * few


def test_graph_parts_cut_few_edges(spark):
    """Of a shuffled grid: even parts, with fewer entries between them than parts by shuffled rows have; also as an ordering."""
    n = 12
    shuffled = spark.range(n * n).select(F.col("id").alias("idx"), (F.col("id") * 7 % (n * n)).alias("perm"))
    grid = sparse(spark, np.kron(np.eye(n), np.eye(n, k=1) + np.eye(n, k=-1)) + np.kron(np.eye(n, k=1) + np.eye(n, k=-1), np.eye(n)))
    a = permute.permute(grid, shuffled, shuffled)
    of = permute.graph_parts(a, 4)
    size = {r["part"]: r["count"] for r in of.groupBy("part").count().collect()}
    assert len(size) == 4 and max(size.values()) - min(size.values()) <= 6
    naive = spark.range(n * n).select(F.col("id").alias("i"), F.floor(F.col("id") / 36).cast("int").alias("part"))
    assert permute.edge_cut(a, of).first()[0] < permute.edge_cut(a, naive).first()[0] / 2
    p = permute.order(a, ["parts", "sort"], parts=4, sigma=2)
    assert sorted(r["perm"] for r in p.collect()) == list(range(n * n))
    assert permute.kacz_ratio(grid) == 144 / 24


def test_rcm_of_an_unsymmetric_pattern(spark):
    """A shuffled rectangular band is narrow again."""
    n, m = 30, 20
    want = np.array([[abs(i * m / n - j) <= 1.0 for j in range(m)] for i in range(n)], float)
    rows, cols = RNG.permutation(n), RNG.permutation(m)
    a = sparse(spark, want[rows][:, cols])
    p, q = permute.rcm_bipartite(a)
    for x, k in ((p, n), (q, m)):
        got = {r["idx"]: r["perm"] for r in x.collect()}
        assert sorted(got) == sorted(got.values()) == list(range(k))
    spread = lambda x: max(np.ptp(np.flatnonzero(r)) for r in x if r.any())
    assert spread(permute.permute(a, p, q).to_numpy()) < spread(want[rows][:, cols])


# row projections
def sweep_np(a, b, x, rows, omega=1.0):
    x = x.copy()
    for i in rows:
        x += omega * (b[i] - a[i] @ x) / (a[i] @ a[i]) * a[i]
    return x


def test_sweeps(spark, band):
    a, m = band
    b, x = RNG.normal(size=40), RNG.normal(size=40)
    assert np.allclose(kaczmarz.kaczmarz(a, vec(spark, b), vec(spark, x), 0.8).to_numpy()[:, 0], sweep_np(m, b, x, range(40), 0.8))
    assert np.allclose(kaczmarz.kaczmarz(a, vec(spark, b), vec(spark, x), backward=True).to_numpy()[:, 0], sweep_np(m, b, x, range(39, -1, -1)))
    colors = spark.range(40).select(F.col("id").alias("i"), (F.col("id") % 3).cast("int").alias("color"))
    by_color = [i for c in range(3) for i in range(c, 40, 3)]
    assert np.allclose(kaczmarz.color_sweep(a, vec(spark, b), vec(spark, x), colors).to_numpy()[:, 0], sweep_np(m, b, x, by_color))
    zone = dist.owner(dist.by_rows(40, 4))
    by_zone = [*range(10), *range(20, 30), *range(10, 20), *range(30, 40)]
    assert np.allclose(kaczmarz.zone_sweep(a, vec(spark, b), vec(spark, x), zone).to_numpy()[:, 0], sweep_np(m, b, x, by_zone))


def test_carp_lowers_the_residual(spark, band):
    a, m = band
    truth = RNG.normal(size=40)
    b, x = m @ truth, np.zeros(40)
    part = dist.owner(dist.by_rows(40, 4))
    want = x
    for order in (1, -1):
        parts = [sweep_np(m, b, want, list(range(10 * p, 10 * p + 10))[::order]) for p in range(4)]
        held = [np.count_nonzero(m[10 * p : 10 * p + 10], axis=0) > 0 for p in range(4)]
        n = np.sum(held, axis=0)
        want = np.where(n > 0, np.sum([np.where(h, q, 0) for h, q in zip(held, parts, strict=True)], axis=0) / np.maximum(n, 1), want)
    got = kaczmarz.carp(a, vec(spark, b), vec(spark, x), part).to_numpy()[:, 0]
    assert np.allclose(got, want) and np.linalg.norm(m @ got - b) < np.linalg.norm(b)


def test_block_multicolour_with_a_rest(spark):
    """Blocks within slices, then those over two slices, then rows that reach further, by colours: every row is projected onto once, as a plain sweep in that order does."""
    n = 24
    m = np.zeros((n, n))
    for i in range(n):
        m[i, max(0, i - 1) : i + 2] = 1.0 + i
    for i in (2, 9):
        m[i, [1, 22]] = 2.0
    a = sparse(spark, m)
    b, x = RNG.normal(size=n), RNG.normal(size=n)
    zone = {r["i"]: r["zone"] for r in permute.block_zones(a, 4).collect()}
    rest = a.with_df(a.df.where(F.col("i").isin([i for i in zone if zone[i] == 8])))
    color = {r["i"]: r["color"] for r in permute.color(rest).collect()}
    phase = lambda i: (3, color[i]) if zone[i] == 8 else (0, 0) if zone[i] % 2 == 0 else (1 if zone[i] % 4 == 1 else 2, 0)
    order = sorted(range(n), key=lambda i: (phase(i), i))
    assert any(zone[i] == 8 for i in zone)
    assert np.allclose(kaczmarz.block_multicolor(a, vec(spark, b), vec(spark, x), 4).to_numpy()[:, 0], sweep_np(m, b, x, order))
    back = sorted(range(n), key=lambda i: ((-phase(i)[0], -phase(i)[1]), -i))
    assert np.allclose(kaczmarz.block_multicolor(a, vec(spark, b), vec(spark, x), 4, backward=True).to_numpy()[:, 0], sweep_np(m, b, x, back))


def test_sweep_in_four_phases(spark):
    """Zones of two colours, each parted where its rows lead over to the next: a sweep by phases is a plain one in that order."""
    n = 48
    a = SparseMatrix.stencil(spark, n, {-2: 1.0, -1: -1.0, 0: 4.0, 1: -1.0, 2: 0.5})
    m, offs = a.to_numpy(), permute.dissect(a, 3)
    four = permute.four_zones(a, offs)
    assert len(four) == 2 * (len(offs) - 1) + 1 and four == sorted(four) and four[2] - four[1] == 2
    assert permute.zones_disjoint(a, offs) and permute.zones_disjoint(a, four, 4) and not permute.zones_disjoint(a, list(range(n + 1)), 1)
    b, x = RNG.normal(size=n), RNG.normal(size=n)
    order = [i for ph in range(4) for z in range(ph, len(four) - 1, 4) for i in range(four[z], four[z + 1])]
    assert np.allclose(kaczmarz.zone_sweep(a, vec(spark, b), vec(spark, x), dist.owner(four), phases=4).to_numpy()[:, 0], sweep_np(m, b, x, order))


def test_operands_follow_a_permutation(spark):
    x = RNG.normal(size=(6, 2))
    p, q = (spark.createDataFrame([(i, int(k)) for i, k in enumerate(RNG.permutation(6))], "idx long, perm long") for _ in range(2))
    v = vec(spark, x)
    by_p, by_q = permute.permute_vector(v, p), permute.permute_vector(v, q)
    assert permute.match_permutation(by_p, p, p) is by_p
    assert np.allclose(permute.match_permutation(by_p, p, q).to_numpy(), by_q.to_numpy())
    assert np.allclose(permute.match_permutation(by_p, p, None).to_numpy(), x) and np.allclose(permute.match_permutation(v, None, q).to_numpy(), by_q.to_numpy())


def test_typecodes():
    assert formats.typecode_string("MCRG") == "matrix coordinate real general" and formats.typecode("%%MatrixMarket matrix coordinate complex skew-symmetric\n") == "MCCK"
    for bad in (lambda: formats.typecode_string("MXRG"), lambda: formats.typecode("%%MatrixMarket matrix coordinate real"), lambda: formats.typecode("hello")):
        with pytest.raises(ValueError):
            bad()


def test_widths_are_measured(spark, band):
    a, m = band
    ticks = iter([0.0, 3.0, 3.0, 4.0])
    got = kaczmarz.tune_parts(a, vec(spark, RNG.normal(size=40)), vec(spark, np.zeros(40)), [2, 4], clock=lambda: next(ticks))
    assert [r[0] for r in got] == [4, 2] and got[0][1] == 1.0


def test_shifted_sweep_over_parts(spark, band):
    """Two parts sweep on copies, and what both hold is averaged."""
    a, m = band
    b, x = RNG.normal(size=40), RNG.normal(size=(40, 1)) + 1j * RNG.normal(size=(40, 1))
    s = 0.5 + 1j
    part = dist.owner([0, 20, 40])
    rows = spark.createDataFrame([(i, 0, float(v.real), float(v.imag)) for i, v in enumerate(x[:, 0])], "i long, k int, re double, im double")
    rhs = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(b)], "i long, re double, im double")
    got = np.zeros(40, complex)
    for r in kaczmarz.shifted_part_sweep(a, rhs, rows, [s], part).collect():
        got[r["i"]] = complex(r["re"], r["im"])
    copies, held = [], []
    for p in range(2):
        z = x[:, 0].copy()
        for i in range(20 * p, 20 * p + 20):
            row = m[i].astype(complex)
            row[i] -= s
            z += (b[i] - row @ z) / (abs(row) ** 2).sum() * row.conj()
        copies.append(z)
        held.append(np.count_nonzero(m[20 * p : 20 * p + 20], axis=0) > 0)
    want = (copies[0] * held[0] + copies[1] * held[1]) / (held[0].astype(int) + held[1])
    assert np.allclose(got, want)


def test_shifted_sweep(spark, band):
    a, m = band
    b, x = RNG.normal(size=40), np.zeros((40, 2), complex)
    got = kaczmarz.shifted_sweep(a, b, x, [0.5, 1 + 2j])
    for k, s in enumerate((0.5, 1 + 2j)):
        z = np.zeros(40, complex)
        for i in range(40):
            row = m[i].astype(complex)
            row[i] -= s
            z += (b[i] - row @ z) / (abs(row) ** 2).sum() * row.conj()
        assert np.allclose(got[:, k], z)


# files
def test_matrix_market(spark, tmp_path):
    f = tmp_path / "a.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real symmetric\n% made here\n3 3 3\n1 1 2.0\n3 1 -1.5\n2 2 4\n")
    a = formats.read_mm(spark, str(f)).to_numpy()
    assert np.array_equal(a, [[2, 0, -1.5], [0, 4, 0], [-1.5, 0, 0]])
    g = tmp_path / "g.mtx"
    g.write_text("%%MatrixMarket matrix coordinate real general\n2 3 2\n2 3 2\n1 2 7\n")  # an entry that looks like the size line
    b = formats.read_mm(spark, str(g))
    assert np.array_equal(b.to_numpy(), [[0, 7, 0], [0, 0, 2]])
    assert np.array_equal(formats.read_mm(spark, str(g), transpose=True).to_numpy(), b.to_numpy().T)
    formats.write_mm(b, str(tmp_path / "out"))
    assert np.array_equal(formats.read_mm(spark, str(tmp_path / "out")).to_numpy(), b.to_numpy())
    z = tmp_path / "z.mtx"
    z.write_text("%%MatrixMarket matrix coordinate complex general\n2 2 1\n1 2 3 -4\n")
    r = formats.read_mm(spark, str(z)).df.first()
    assert (r["i"], r["j"], r["v"]["re"], r["v"]["im"]) == (0, 1, 3.0, -4.0)
    for bad in ("pattern general", "real skew-symmetric", "complex hermitian"):
        z.write_text(f"%%MatrixMarket matrix coordinate {bad}\n2 2 1\n1 2 3\n")
        with pytest.raises(ValueError):
            formats.read_mm(spark, str(z))
    with pytest.raises(ValueError):
        formats.read_mm(spark, str(g), want=DType.Z)


@pytest.mark.parametrize("split", [1, 7, 100])
def test_binary_files(spark, tmp_path, split):
    m = random_sparse(20, 20, 0.2)
    m[5] = 0
    formats.write_bincrs(sparse(spark, m), str(tmp_path / "a.crs"))
    assert (tmp_path / "a.crs").stat().st_size == 44 + 8 * 21 + 16 * np.count_nonzero(m)
    assert np.array_equal(formats.read_bincrs(spark, str(tmp_path / "a.crs"), split).to_numpy(), m)
    x = RNG.normal(size=(20, 3))
    formats.write_bindense(vec(spark, x), str(tmp_path / "x.bin"))
    assert np.array_equal(formats.read_bindense(spark, str(tmp_path / "x.bin"), split).to_numpy(), x)
    raw = (tmp_path / "x.bin").read_bytes()
    (tmp_path / "x.bin").write_bytes(raw[:8] + b"\x01\0\0\0" + raw[12:32] + np.asfortranarray(x).tobytes("F"))
    assert np.array_equal(formats.read_bindense(spark, str(tmp_path / "x.bin"), split).to_numpy(), x)
    (tmp_path / "a.crs").write_bytes((tmp_path / "a.crs").read_bytes()[:-1])
    with pytest.raises(ValueError):
        formats.read_bincrs(spark, str(tmp_path / "a.crs"))


def test_complex_files(spark, tmp_path):
    rows = [(0, 1, (3.0, -4.0)), (1, 0, (0.5, 1e-9)), (1, 1, (-2.0, 0.0))]
    a = SparseMatrix(spark.createDataFrame(rows, "i long, j long, v struct<re:double,im:double>"), 2, 3, formats.MatrixTraits(dtype=DType.Z))
    plain = lambda m: sorted((r["i"], r["j"], (r["v"]["re"], r["v"]["im"])) for r in m.df.collect())
    formats.write_mm(a, str(tmp_path / "z"))
    assert plain(formats.read_mm(spark, str(tmp_path / "z"))) == rows
    formats.write_mm(a, str(tmp_path / "short"), precision=3, single=True)
    files = list((tmp_path / "short").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().startswith("%%MatrixMarket matrix coordinate complex general\n2 3 3\n") and "3.00e+00 -4.00e+00" in files[0].read_text()
    formats.write_bincrs(a, str(tmp_path / "z.crs"))
    assert plain(formats.read_bincrs(spark, str(tmp_path / "z.crs"))) == rows


def test_binary_files_are_whole_or_not_there(spark, tmp_path):
    x = BlockVector(spark.range(3).select(F.col("id").alias("i"), F.array(F.lit(1.0)).alias("x")), 4, 1)  # a row is missing
    with pytest.raises(OSError):
        formats.write_bindense(x, str(tmp_path / "x.bin"))
    assert not list(tmp_path.iterdir())
    formats.write_bincrs(SparseMatrix(spark.createDataFrame([], "i long, j long, v double"), 3, 3), str(tmp_path / "e.crs"))
    assert formats.read_bincrs(spark, str(tmp_path / "e.crs")).df.count() == 0


# the rest
def test_normalize_and_random(spark):
    x = np.array([[3.0, 0.0], [4.0, 0.0]])
    got = vec(spark, x).normalize().to_numpy()
    assert np.allclose(got[:, 0], [0.6, 0.8]) and np.isnan(got[:, 1]).all()
    r = BlockVector.rand(spark, 500, 2, 1).to_numpy()
    assert abs(r).max() <= 1 and abs(r.mean()) < 0.1


def test_checks_at_plan_time(spark):
    x = BlockVector.from_scalar(spark, 4, 2, 1)
    for bad in (lambda: x.axpy(1, BlockVector.from_scalar(spark, 5, 2, 1)), lambda: x.columns([1, 0]), lambda: x.view(0, 5, 0, 1), lambda: x.scale([1.0])):
        with pytest.raises(ValueError):
            bad()


def test_chunks_and_models(spark):
    a = sparse(spark, np.array([[1, 1, 1], [1, 0, 0], [0, 0, 0], [1, 1, 0.0]]))
    r = stats.chunk_occupancy(a, 2).first()
    assert (r["nnz"], r["n_ents"]) == (6, 10)
    assert timing.spmv_flops(10, 2) == 40 and timing.spmv_flops(10, 1, DType.Z) == 80
    t = timing.Timings()
    for _ in range(12):
        with t.region("x", gf=timing.gflops(1e9)):
            pass
    s = t.regions["x"].summary()
    assert s["calls"] == 12 and s["min"] <= s["avg"] <= s["max"] and "avg_without_first_10" in t.report()


def test_flops_of_mixed_types():
    assert timing.spmv_flops(10, 1, DType.Z, matrix=DType.D) == 40 and timing.spmv_flops(10, 1, DType.Z, matrix=DType.Z) == 80
    assert timing.gemm_bytes(2, 3, 4) == 8 * (6 + 8 + 12) and timing.gemm_bytes(2, 3, 4, beta=True) == 8 * (12 + 8 + 12)


def test_measured_bandwidths_and_transfers(spark):
    got = timing.bandwidths(spark, 10_000, 1)
    assert set(got) == {"load", "store", "copy", "update", "triad"} and min(got.values()) > 0
    t = timing.Transfers(spark)
    with t.region("shuffle"):
        spark.range(10_000).repartition(4, "id").count()
    assert t.regions["shuffle"][1] > 0 and "shuffle" in t.report()


@pytest.mark.parametrize("window", [1 << 20, 4])
def test_running_sums_in_blocks_of_blocks(spark, window):
    w = RNG.integers(0, 9, 700)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(w)], "k long, w long")
    got = {r["k"]: r["s"] for r in util.prefix_sum(df, "k", "w", "s", 700, 5, window).collect()}
    assert got == dict(enumerate((np.cumsum(w) - w).tolist()))


def test_error_handlers():
    seen = []
    errors.set_handler(ValueError, seen.append)
    try:
        with pytest.raises(ValueError), errors.reported():
            raise ValueError("x")
        with pytest.raises(UnicodeError), errors.reported():
            raise UnicodeError("a kind of ValueError")
        with pytest.raises(KeyError), errors.reported():
            raise KeyError("not handled")
    finally:
        errors.set_handler(ValueError, None)
    assert [type(e) for e in seen] == [ValueError, UnicodeError]


def test_complex_block_operations(spark):
    x, y, w = (RNG.normal(size=(5, 2)) + 1j * RNG.normal(size=(5, 2)) for _ in range(3))
    table = lambda m: spark.createDataFrame([(i, [(float(v.real), float(v.imag)) for v in r]) for i, r in enumerate(m)], "i long, x array<struct<re:double,im:double>>")

    def back(df):
        out = np.zeros((5, 2), complex)
        for r in df.collect():
            out[r["i"]] = [complex(v["re"], v["im"]) for v in r["x"]]
        return out

    a, b, c = [1 + 2j, -1j], [0.5, 2], 3 - 1j
    assert np.allclose(back(complex_ops.axpby(table(y), a, table(x), b, 2)), x * a + y * b)
    assert np.allclose(back(complex_ops.axpbypcz(table(y), a, table(x), b, table(w), c, 2)), x * a + y * b + w * c)
    assert np.allclose(back(complex_ops.mult(table(y), table(x), c)), c * x * y) and np.allclose(back(complex_ops.vscale(table(x), a)), x * a)
    assert np.allclose([r["v"] for r in complex_ops.nrm2(table(x), 2).orderBy("c").collect()], np.linalg.norm(x, axis=0))
    with pytest.raises(ValueError):
        complex_ops.axpby(table(y), [1], table(x), b, 2)


def test_strided_views_and_text(spark):
    x = RNG.normal(size=(11, 3))
    v = vec(spark, x)
    assert np.allclose(v.strided(1, 4, 3, 1).to_numpy(), x[1::3, 1:]) and np.allclose(v.transposed(), x.T)
    assert len(v.to_string().splitlines()) == 11
    with pytest.raises(ValueError):
        v.strided(1, 5, 3)
