"""SimHash near-dedup: exact search of all fingerprint pairs within a radius, by tiles.

A text becomes a 64-bit fingerprint, the majority of its shingles' XXH64 bits. Equal fingerprints are one node. Two
fingerprints that differ in at most r bits agree in k of any k + r bit blocks, so each fingerprint goes to the groups of its
block values, C(k + r, k) of them, and no pair within the radius is lost. Within a group numpy compares tile against tile, by
exclusive-or and bit counts, with the fingerprints sorted by population count: two tiles whose population counts differ beyond
the radius can't hold a link and are skipped. A group larger than a tile is dealt out as a grid of tile pairs, again without the
pairs that population counts rule out, so that no task holds a large group. What a task returns is a spanning
forest of the links it found, never the pairs; components join those forests.

k grows with the number of fingerprints (a count), so that groups stay small at any size; it changes the cost alone, not the links.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle are one
shingle; texts of any length count whole; repeated rows and equal texts share a fingerprint; a row without doc_id gets its fingerprint, and a
component_id only from rows that have a doc_id; an empty table gives no rows; other columns are left out, whatever their names, or kept by the stage.

The pipeline's stage needs links at a shingle similarity of 0.8, where fingerprints differ in about 10 bits, beyond any radius that blocks
can search: it takes SimHash fingerprints of some hundred bits, in bands (simhash_bands), and holds what is near to the sets themselves (shingle_sets).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, apart, bounded, checkpointed, free_name, map_arrow, table
from .components import components
from .shingle_sets import near_copies

RADIUS, SHINGLE, SEED, TILE = 4, 4, 42, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(buf, seed)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), "u8", n - shingle + 1)
    ones = np.zeros(64, "i8")
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): the fingerprint as a signed number."""

    def fn(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "fp": np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], "u8").view("i8")}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, fp long")


def plan_blocks(n: int, radius: int = RADIUS, per_group: int = 2048) -> tuple[int, int]:
    """Blocks, and how many of them must agree, for n fingerprints: the fewest that make groups of about per_group."""
    for k in range(1, 5):
        if n / 2.0 ** (64 * k / (k + radius)) <= per_group:
            break
    return k + radius, k


def _group_keys(fp: Column, blocks: int, agree: int) -> Column:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(mask)).alias("k")))
    return F.array(*keys)


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> None:
    """Hooks the pairs into label, the least index of each piece, in place."""
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while len(i):
        a, b = label[i], label[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        m = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), m)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def tile_links(fp: np.ndarray, side: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For each fingerprint the least index of those it is linked to within the group. side: 0 or 1 in a cell of two tiles, compared across only; 2 where all pairs count."""
    n = len(fp)
    label = np.arange(n)
    pop = np.bitwise_count(fp).astype("i2")
    order = np.argsort(pop, kind="stable")
    step = min(tile, 256)
    left = order[side[order] != 1]
    right = order[side[order] != 0]
    for s in range(0, len(left), step):
        li = left[s : s + step]
        for t in range(0, len(right), step):
            rj = right[t : t + step]
            if pop[rj[0]] - pop[li[-1]] > radius:
                break
            if pop[li[0]] - pop[rj[-1]] > radius or (t + step <= s and len(left) == len(right) == n):
                continue
            near = np.bitwise_count(fp[li, None] ^ fp[None, rj]) <= radius
            near &= label[li, None] != label[None, rj]  # what is in one piece already adds nothing
            i, j = near.nonzero()
            if len(i):
                _forest(n, [(li[i], rj[j])], label)
    return label


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: tuple[int, int] | None = None) -> DataFrame:
    """fps(fp, rep), distinct, to (a, b): forests over rep that join all fingerprints within the radius."""
    m, agree = blocks or plan_blocks(fps.count(), radius)
    if m - agree != radius:
        raise ValueError("blocks - agree must be the radius")
    keyed = fps.select("fp", "rep", F.explode(_group_keys(F.col("fp"), m, agree)).alias("g")).select("fp", "rep", "g.c", "g.k")
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    k = [F.col("c").alias("__c"), *apart("k")]
    cells = keyed.select("fp", "rep", "c", "k", *k).join(sizes.select("n", *k), ["__c", "__k0"]).select("fp", "rep", "c", "k", "n")
    pop = F.bit_count("fp")
    salts = F.ceil(F.col("n") / F.lit(8 * tile)).cast("int")
    own = F.struct(pop.alias("p"), F.pmod(F.xxhash64("fp"), salts).cast("int").alias("s"))
    others = F.flatten(
        F.transform(F.sequence(F.greatest(pop - radius, F.lit(0)), F.least(pop + radius, F.lit(64))), lambda p: F.transform(F.sequence(F.lit(0), salts - 1), lambda s: F.struct(p.alias("p"), s.cast("int").alias("s"))))
    )
    pair = lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), F.when(own == o, F.lit(2)).when(own < o, F.lit(0)).otherwise(F.lit(1)).alias("side"))
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("s"))
    whole = F.array(F.struct(none.alias("lo"), none.alias("hi"), F.lit(2).alias("side")))
    dealt = cells.select("fp", "rep", "c", "k", F.explode(F.when(F.col("n") > tile, F.transform(others, pair)).otherwise(whole)).alias("t"))
    cell = F.xxhash64("c", "k", "t.lo.p", "t.lo.s", "t.hi.p", "t.hi.s")  # cells that share a hash are told apart below
    rows = dealt.select(cell.alias("cell"), "c", "k", F.col("t.lo.p").alias("p0"), F.col("t.lo.s").alias("s0"), F.col("t.hi.p").alias("p1"), F.col("t.hi.s").alias("s1"), F.col("t.side").alias("side"), "fp", "rep")
    by = ["cell", "c", "k", "p0", "s0", "p1", "s1"]
    rows = rows.repartition("cell").sortWithinPartitions(*by)

    def run(batches):
        kept = None  # the last cell may go on in the next batch

        def links(x):
            fp, rep, side = x["fp"].view("u8"), x["rep"], x["side"]
            ids = np.stack([x[c].astype("i8") for c in by])
            cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            a, b = [], []
            for s, e in zip([0, *cut], [*cut, len(fp)], strict=True):
                if e - s > 1:
                    if e - s == 2:
                        if side[s] + side[s + 1] not in (1, 4) or int(fp[s] ^ fp[s + 1]).bit_count() > radius:
                            continue
                        a.append(rep[s : s + 1])
                        b.append(rep[s + 1 : s + 2])
                        continue
                    label = tile_links(fp[s:e], side[s:e], radius, tile)
                    i = np.flatnonzero(label != np.arange(e - s))
                    if len(i):
                        a.append(rep[s:e][i])
                        b.append(rep[s:e][label[i]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if kept is not None:
                x = {c: np.concatenate([kept[c], v]) for c, v in x.items()}
            if not len(x["fp"]):
                continue
            same = np.logical_and.reduce([x[c] == x[c][-1] for c in by])
            s = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if s:
                yield from links({c: v[:s] for c, v in x.items()})
            kept = {c: v[s:] for c, v in x.items()}
        if kept is not None:
            yield from links(kept)

    return rows.select(*by, "side", "fp", "rep").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id)."""
    rows = checkpointed(fingerprints(docs))  # 16 bytes a document
    fps = checkpointed(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(near_links(fps, radius))
    named = fps.join(comp.select(F.col("a").alias("rep"), F.col("b").alias("least")), "rep", "left").select(F.coalesce("least", "rep").alias("component_id"), *apart("fp"))
    return rows.select("doc_id", "fp", *apart("fp")).join(named, "__k0", "left").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component of near copies by SimHash, verified on five-word shingles (shingle_sets), what has its smallest doc_id (one document; rows that repeat it stay with it); rows without doc_id stay.

    Rows that share a doc_id are told apart by a hash of the text.
    """
    groups = near_copies(docs)
    d, h = free_name(docs, "__gone"), free_name(docs, "__h")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct()
    return docs.join(bounded(gone), (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
