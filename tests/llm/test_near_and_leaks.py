import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veldt.llm import decontam, shingle_sets, simhash, simhash_bands
from veldt.llm.common import bounded
from veldt.llm.components import components

from .made import SCHEMA, docs, groups, odd_rows, prose

LOWER = {c: c + 32 for c in range(65, 91)}


# SimHash
def fingerprint_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    for t in [t for _, t in odd_rows()] + ["One", "One TWO", "a b c d", "a b c d e", prose(rng, 50), "É é Ä"]:
        if len(t or "") < 60_000:
            assert simhash.fingerprint(t) == fingerprint_by_hand(t), t


def near_rows(rng, n):
    """Fingerprints: chains within the radius, a dense clump, and others."""
    out = set()
    for _ in range(n // 4):
        x = rng.getrandbits(64)
        for _ in range(4):
            out.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    clump = rng.getrandbits(64)
    out |= {clump ^ (1 << a) ^ (1 << b) for a, b in combinations(range(12), 2)}
    return sorted(out)


@pytest.mark.parametrize("blocks, tile", [(None, 2048), ((5, 1), 16), ((6, 2), 2048), ((7, 3), 8)])
def test_no_link_is_lost(spark, blocks, tile):
    fps = near_rows(random.Random(2), 600)
    signed = np.array(fps, "u8").view("i8").tolist()
    links = simhash.near_links(spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, rep long"), 4, tile, blocks)
    got = {k: k for k in range(len(fps))} | {r["a"]: r["b"] for r in components(links).collect()}
    a = np.array(fps, "u8")
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 4, 1))
    assert got == groups(range(len(fps)), zip(i.tolist(), j.tolist(), strict=True))


def test_groups_of_documents(spark):
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(30)]
    rows = [(k, base[k % 30] + (f" tail{k}" if k % 3 else "")) for k in range(90)] + [(1000 + k, base[0]) for k in range(200)] + [(2000 + i if i is not None else None, t) for i, t in odd_rows()]
    got = simhash.near_groups(docs(spark, rows, ("fp", "rep", "__k0"))).collect()
    assert len(got) == len(rows)
    fp = {i: fingerprint_by_hand(t) for i, t in rows if i is not None and len(t or "") < 60_000} | {r["doc_id"]: r["fp"] % 2**64 for r in got if r["doc_id"] == 2006}
    want = groups(sorted(fp), [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["fp"] % 2**64 == fp[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    rows = [(1, x := prose(rng, 200)), (2, x), (3, x), (4, prose(rng, 200)), (None, x), (None, None), (9, None), (8, "")]
    df = docs(spark, rows, ("__gone", "component_id"))
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 4, 8, None, None]
    assert simhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_are_joined_like_short_ones(spark, monkeypatch):
    """Beyond the bound nothing is broadcast, and the same rows stay."""
    rng = random.Random(14)
    leak = prose(rng, 20)
    rows = [(k, x) for k, x in enumerate([prose(rng, 200) for _ in range(6)] * 2)] + [(50, f"a b {leak}"), (None, leak), (None, None)]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    df = docs(spark, rows)
    kept = lambda d: sorted(str((r["doc_id"], r["text"])) for r in d.collect())
    short = kept(simhash.drop_near_copies(df)), kept(decontam.drop_contaminated(df, bench))
    for m in (simhash, shingle_sets, decontam):
        monkeypatch.setattr(m, "bounded", lambda d: bounded(d, 0))
    assert short == (kept(simhash.drop_near_copies(df)), kept(decontam.drop_contaminated(df, bench)))
    assert len(short[0]) == 9 and len(short[1]) == 13


def test_a_repeated_id_loses_only_the_copy(spark):
    rng = random.Random(7)
    x, y, z = (prose(rng, 100) for _ in range(3))
    got = simhash.drop_near_copies(docs(spark, [(2, y), (5, x), (5, y), (7, x), (8, z)]))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(2, y), (5, x), (8, z)])


def test_near_copies_are_those_of_plain_sets(spark, monkeypatch):
    """Ten edits a copy of 300 words are similar at about 0.7 to 0.9, beyond four bits; small tiles make a grid."""
    monkeypatch.setattr(shingle_sets, "TILE", 8)
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        base = prose(rng, 300).split()
        for _ in range(rng.choice((2, 4, 30))):
            w = list(base)
            for p in rng.sample(range(300), rng.choice((2, 5, 7, 10))):
                w[p] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = groups(range(len(rows)), links)
    assert len(set(want.values())) < len(rows) - 20
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(docs(spark, rows)).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()} == set(want.values())


def test_near_copies_come_from_simhash(spark):
    """The stage's fingerprints are majorities over the bits of five-word shingles; without words there is none."""
    rng = random.Random(21)
    rows = [(k, prose(rng, n)) for k, n in enumerate((1, 5, 6, 8, 9, 10, 300, 2000))] + [(50, " ".join(["a"] * 40)), (51, None), (52, " \n")]
    got = {r["doc_id"]: (r["fp"], r["small"]) for r in shingle_sets.sketches(docs(spark, rows), 5).collect()}
    for i, t in rows:
        w = (t or "").split()
        h = sorted({xxhash.xxh64_intdigest(" ".join(w[j : j + 5])) for j in range(max(1, len(w) - 4))}) if w else []
        table = [[int(x) for x in r] for r in simhash_bands.bit_hashes(np.array(h, "u8"), 5)]
        want = b"".join(sum(1 << b for b in range(64) if 2 * sum(r[c] >> b & 1 for r in table) > len(h)).to_bytes(8, "little") for c in range(5)) if h else None
        assert got[i] == (want, len(h) <= 5), i


@pytest.mark.parametrize("common, more", [(4, 1), (5, 1), (12, 3), (20, 5), (200, 50)])
def test_bits_agree_as_the_bands_assume(common, more):
    """Sets just similar enough: the share of equal bits, and no pair that differs in more than the radius."""
    rng = np.random.default_rng(common)
    small = common + more <= simhash_bands.SMALL
    least, radius = (simhash_bands.AGREE_SMALL, simhash_bands.RADIUS_SMALL) if small else (simhash_bands.AGREE, simhash_bands.RADIUS)
    d = []
    for _ in range(400):
        s = rng.integers(0, 1 << 63, common + more, "u8")
        one, two = (np.frombuffer(simhash_bands.fingerprint(x, 3), "u8") for x in (s[:common], s))
        d.append(int(np.bitwise_count(one ^ two).sum()))
    assert max(d) <= radius
    assert 1 - np.mean(d) / 192 > least - 0.006


@pytest.mark.parametrize("n", [0, 200, 10**4, 10**6, 10**9])
def test_bands_miss_as_little_as_said(n):
    p = simhash_bands.plan(n)
    assert (1 - simhash_bands.AGREE**p.k) ** p.bands < 1e-5 > (1 - simhash_bands.AGREE_SMALL**p.k) ** p.small
    assert n / 2**p.k <= simhash_bands.PER_GROUP and 64 * p.words >= max(simhash_bands.CHECK, p.small * p.k)


@pytest.mark.parametrize("tile", [8192, 300, 1])
def test_pieces_are_those_of_all_pairs(tile):
    """A clump, chains, pairs at the radius and just beyond it, and others."""
    rng = random.Random(22)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(192), k))
    hot = rng.getrandbits(192)
    xs = [flip(hot, rng.randrange(40)) for _ in range(400)] + [rng.getrandbits(192) for _ in range(200)]
    for k in (31, 32, 61, 62, 63, 80):
        xs += [flip(x, k) for x in xs[400:420]]
    rng.shuffle(xs)
    f = np.array([[x >> 64 * w & (2**64 - 1) for x in xs] for w in range(3)], "u8")
    want = groups(range(len(xs)), [(i, j) for i, j in combinations(range(len(xs)), 2) if (xs[i] ^ xs[j]).bit_count() <= 62])
    assert 100 < len(set(want.values())) < len(xs) - 450
    assert simhash_bands.pieces(f, 62, tile).tolist() == [want[i] for i in range(len(xs))]


def test_short_near_copies_are_linked(spark):
    """Eight words and nine: four shingles of five, the least likely bits; in groups of a half, a quarter, and so on."""
    rng = random.Random(23)
    rows = [(2 * k + i, " ".join(w[: 8 + i])) for k in range(1500) for w in [[f"v{rng.randrange(10**6)}" for _ in range(9)]] for i in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def inner_join_rows(spark, seen=frozenset()):
    """The rows that each inner join of this session's queries has made, by its metric."""
    out, store = {}, spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList().iterator()
    while runs.hasNext():
        run = runs.next().executionId()
        made, nodes = store.executionMetrics(run), store.planGraph(run).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if "Join" in node.name() and "Inner" in node.desc() and m.name() == "number of output rows" and (v := made.get(m.accumulatorId())).isDefined():
                    out[run, m.accumulatorId()] = int(v.get().replace(",", ""))
    return {k: v for k, v in out.items() if k not in seen}


def test_joins_hold_a_near_copy_once_not_once_a_band(spark):
    """One large group of near copies, few of which are similar enough: it lies in pieces of many bands."""
    rng = random.Random(24)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(600):
        w = list(base)
        for p in rng.sample(range(150), rng.choice((2, 6, 8))):
            w[p] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = groups(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    assert 300 < len(set(want.values())) < 500
    df, before = docs(spark, rows), inner_join_rows(spark)
    assert {r["doc_id"]: r["component_id"] for r in shingle_sets.near_copies(df).collect()} == want
    assert 0 < sum(inner_join_rows(spark, before).values()) <= 8 * len(rows)


def test_groups_are_merged_or_stay_in_pieces(spark, monkeypatch):
    """Pieces that share texts become one group; a chain far above a tile stays in its distinct pieces, as its grid would make more rows."""
    monkeypatch.setattr(shingle_sets, "TILE", 8)
    clump = {100 + b: [1000 + k for k in range(20) if k != b] for b in range(5)}
    chain = {200 + k: [2000 + k, 2001 + k] for k in range(60)} | {300: [2000, 2001]}
    pair = {400: [3000, 3001], 401: [3000, 3001]}
    banded = spark.createDataFrame([(b, min(x), n) for b, x in (clump | chain | pair).items() for n in x], "band long, root long, node long")
    got = defaultdict(list)
    for r in shingle_sets.candidate_groups(banded).collect():
        got[r["band"], r["n"], r["pivot"]].append(r["node"])
    assert all(n == len(x) and pivot in x for (_, n, pivot), x in got.items())
    assert sorted(sorted(x) for x in got.values()) == sorted([list(range(1000, 1020)), *([2000 + k, 2001 + k] for k in range(60)), [3000, 3001]])


@pytest.mark.parametrize("max_local", [10**6, 0])
def test_components_of_chains_and_stars(spark, max_local):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a long, b long"), max_local=max_local).collect()}
    assert components(spark.createDataFrame([], "a long, b long"), max_local=max_local).count() == 0
    want = groups(sorted({n for x in links for n in x}), links)
    assert got == {n: m for n, m in want.items() if n != m}


# decontamination
def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def leaks_by_hand(rows, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if w and i is not None else 0):
            windows[tuple(w[s : s + k])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = tokens(t)
        hit, found = set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                own = windows.get(tuple(w[s : s + k]))
                if own:
                    hit |= set(range(s, s + k))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_tables(spark):
    rng = random.Random(6)
    passages = [prose(rng, k, 60) for k in (3, 8, 10, 11, 25, 40)]
    items = [(k, p) for k, p in enumerate(passages)] + [(90, passages[3]), (91, None), (92, "..."), (None, passages[4]), (93, "ABC-def É9 日本")]
    rows = [(100 + k, f"{prose(rng, rng.randrange(0, 30), 60)} {rng.choice(passages)[rng.randrange(0, 6) :].upper()}, {prose(rng, rng.randrange(0, 20), 60)}") for k in range(150)]
    rows += [(300, " ".join([passages[0]] * 200)), (301, "abc DEF é9 日本 abc def É9 日本"), *odd_rows()]
    return rows, items


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_leaks(spark, most):
    rows, items = leak_tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(spark, rows, ("th", "w", "len", "d", "h")), bench, max_broadcast=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == leaks_by_hand(rows, items)


def test_clean_documents_stay(spark):
    rows, items = leak_tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows, ("__d", "__h", "word", "items"))
    got = decontam.drop_contaminated(df, bench)
    want = sorted((str(x[0]) for x in leaks_by_hand(rows, items) if not x[-1]))
    assert got.columns == df.columns and sorted(str(r["doc_id"]) for r in got.collect()) == want
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == len(rows)
    assert decontam.drop_contaminated(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_passages_without_id_are_dropped(spark, most):
    rng = random.Random(8)
    leak = prose(rng, 20)
    bench = spark.createDataFrame([(None, leak), (1, prose(rng, 20))], "item_id long, text string")
    d = docs(spark, [(1, f"a b {leak} c"), (2, prose(rng, 40))])
    assert [r["doc_id"] for r in decontam.drop_contaminated(d, bench, max_broadcast=most).collect()] == [2]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "red green blue")], "item_id long, text string")
    d = docs(spark, [(1, "x one four y three two z"), (2, "one x x x x x x x x x x two three four"), (3, "blue, green. RED"), (4, "red green")])
    got = decontam.proximity(d, bench, slop=2).select("doc_id", F.explode("items").alias("item")).distinct().collect()
    assert {(r["doc_id"], r["item"]) for r in got} == {(1, 1), (3, 2)}


def test_proximity_spans_no_more_than_asked(spark):
    """The first row has all words within three of the rarest, but in a span of seven words, not five."""
    bench = spark.createDataFrame([(1, "left rare right")], "item_id long, text string")
    d = docs(spark, [(1, "left x x rare x x right"), (2, "x left x rare x right"), (3, "left left right right")])
    assert {r["doc_id"] for r in decontam.proximity(d, bench, slop=2).collect()} == {2}
