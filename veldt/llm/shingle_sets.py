"""Near copies by sets of five-word shingles: texts whose sets have a Jaccard similarity of 0.8 or more are linked, after exact checks.

A node is a text's lower-case words, told apart by a 64-bit hash. Candidates are near by SimHash (simhash_bands): fingerprints of the sets that share a
band and differ in few bits, so that a pair at 0.8 is missed with probability below 1e-5, and less above. Every candidate pair is held to the exact similarity of
the whole sets, unless other links have joined its two texts already. Pieces of many bands that share texts are merged to one group, so that a text is held once,
not once a band; a group of several tiles stays in its pieces, those of the same texts once, where fewer rows come of that. First each text of a group is held to the
group's pivot; then, in groups of three or more that aren't one component by now, all pairs across
components, in numpy, where a large group is dealt out as a grid of tile pairs; in groups of more than some dozens, those within the radius.
Sets are made for candidates only; texts are not shuffled, unless candidates are too many to be broadcast.

Defined cases: null and empty texts and those without words are one node; up to five words are one shingle; texts of any length count whole; rows without
doc_id are left out; equal texts and repeated rows share a node; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, apart, bounded, checkpointed, give_back, map_arrow
from .components import components
from .simhash_bands import CHECK, RADIUS_SMALL, SMALL, fingerprint, near_pieces, plan

SHINGLE, FEW = 5, 64
#: Texts of a tile; groups of more than FINE are dealt out as up to PARTS smaller tiles, so that more tasks share them.
TILE, FINE, PARTS = 1024, 256, 12


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ASCII_LOWER).split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all shingles."""
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= SHINGLE:
        return np.array([digest(b" ".join(words))] if n else [], "u8")
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE])) for i in range(n - SHINGLE + 1)), "u8", n - SHINGLE + 1))


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words)) if words else 0


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, node, fp, small): th is the hash of the text as it is, fp the SimHash of its set (none without words), small whether the set takes more bands."""

    def fn(b: pa.RecordBatch) -> dict:
        w = [words_of(t) for t in b.column("text").to_pylist()]
        sets = [shingle_set(x) for x in w]
        return {
            "doc_id": b.column("doc_id"),
            "th": b.column("th"),
            "node": np.array([_node(x) for x in w], "u8").view("i8"),
            "fp": pa.array([fingerprint(s, words) if len(s) else None for s in sets], pa.binary()),
            "small": pa.array([len(s) <= SMALL for s in sets], pa.bool_()),
        }

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text"), fn, "doc_id long, th long, node long, fp binary, small boolean")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the texts whose hashes are wanted(t)."""

    def fn(b: pa.RecordBatch) -> dict:
        w = [words_of(t) for t in b.column("text").to_pylist()]
        return {"node": np.array([_node(x) for x in w], "u8").view("i8"), "set": pa.array([shingle_set(x).tobytes() for x in w], pa.binary())}

    texts = docs.select("text", F.xxhash64("text").alias("t")).join(bounded(wanted), "t", "left_semi").select("text")
    return map_arrow(texts, fn, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def alike(one: np.ndarray, sets: list[np.ndarray], num: int = 4, den: int = 5) -> np.ndarray:
    """Which of the sets (none is empty) have a similarity of num / den or more with one, in whole numbers."""
    flat, n = np.concatenate(sets), np.array([len(x) for x in sets])
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype("i8"), np.cumsum(n) - n)
    return den * both >= num * (len(one) + n - both)


def group_links(node: list[int], comp: list[int], sets: list[np.ndarray], words: int = CHECK // 64) -> list[tuple[int, int]]:
    """Links that join all components of a group: every pair across two is compared, by sizes that allow a link, and of more than FEW sets by fingerprints (of so many words) within the wider radius."""
    order = sorted(range(len(node)), key=lambda i: len(sets[i]))
    node, sets = [node[i] for i in order], [sets[i] for i in order]
    label = np.unique([comp[i] for i in order], return_inverse=True)[1]
    n, out = np.array([len(x) for x in sets]), []
    fp = np.array([np.frombuffer(fingerprint(x, words), "u8")[: CHECK // 64] for x in sets]) if len(node) > FEW else None
    for i in range(len(node)):
        end = int(np.searchsorted(n, n[i] * 5 // 4, "right"))
        j = i + 1 + np.flatnonzero(label[i + 1 : end] != label[i])
        if fp is not None:
            j = j[np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= RADIUS_SMALL]
        if len(j):
            for k in j[alike(sets[i], [sets[x] for x in j])].tolist():
                if label[k] != label[i]:
                    out.append((node[i], node[k]))
                    label[label == label[k]] = label[i]
    return out


def _tiles(n: Column) -> Column:
    """Tiles of a group of n texts, each of which goes to a cell with each other tile."""
    return F.greatest(F.ceil(n / F.lit(TILE)), F.least(F.ceil(n / F.lit(FINE)), F.lit(PARTS))).cast("int")


def candidate_groups(banded: DataFrame) -> DataFrame:
    """banded(band, root, node) to (band, node, pivot, n): the pieces' components, or, of those dealt out by tiles, the distinct pieces where these make fewer rows by their grids."""
    least = components(banded.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("b").alias("c"), *apart("a"))
    spots = checkpointed(banded.select("node").distinct().select("node", *apart("node")).join(least, "__k0", "left").select("node", F.coalesce("c", "node").alias("c")))
    dealt = F.col("n") * F.greatest(_tiles(F.col("n")) - 1, F.lit(1))
    large = spots.groupBy("c").agg(F.count("*").alias("n")).where(_tiles(F.col("n")) > 2).select(dealt.alias("whole"), *apart("c"))
    pieces = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("root").alias("root"))
    pieces = pieces.select("band", "n", "x", "root", *apart("root")).join(least, "__k0", "left").select("band", "n", "x", F.coalesce("c", "root").alias("c"))
    pieces = pieces.select("band", "n", "x", "c", *apart("c")).join(bounded(large), "__k0").groupBy("c", "whole", "n", "x").agg(F.min("band").alias("band"))
    pieces = checkpointed(pieces)
    cut = pieces.groupBy("c", "whole").agg(F.sum(dealt).alias("parts")).where("parts < whole").select(*apart("c"))
    cut = bounded(cut)
    whole = spots.select("node", "c", *apart("c")).join(cut, "__k0", "left_anti").select(F.col("c").alias("band"), "node")
    parts = bounded(pieces.select("band", *apart("c")).join(cut, "__k0", "left_semi").select(*apart("band")))
    parts = banded.select("band", "node", *apart("band")).join(parts, "__k0", "left_semi").select("band", "node")
    groups = checkpointed(whole.unionAll(parts))
    about = groups.groupBy("band").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "band")).alias("pivot"))
    return groups.select("band", "node", *apart("band")).join(about.select("n", "pivot", *apart("band")), "__k0").select("band", "node", "pivot", "n")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, component_id) of the rows that have a doc_id; component_id is the least doc_id of the component."""
    docs = docs.where("doc_id is not null")
    p = plan(docs.count())
    rows = checkpointed(sketches(docs, p.words))  # some 60 bytes a document and the fingerprint
    nodes = rows.groupBy("node").agg(F.min("th").alias("t"), F.first("fp").alias("fp"), F.first("small").alias("small"))
    banded = checkpointed(near_pieces(nodes.where("fp is not null"), p))
    members = checkpointed(candidate_groups(banded))
    wanted = rows.groupBy("node").agg(F.min("th").alias("t")).join(bounded(members.select("node").distinct()), "node", "left_semi")
    sets = checkpointed(_sets(docs, wanted.select("t").distinct()))

    def verified(b: pa.RecordBatch) -> dict:
        one, other = ([np.frombuffer(x, "u8") for x in b.column(c).to_pylist()] for c in ("set", "set2"))
        ok = pa.array([bool(alike(x, [y])[0]) for x, y in zip(one, other, strict=True)], pa.bool_())
        return {"a": b.column("a").filter(ok), "b": b.column("b").filter(ok)}

    star = members.where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    star = star.select("a", "b", *apart("a")).join(sets.select("set", *apart("node")), "__k0").select("a", "b", "set", *apart("b"))
    star = star.join(sets.select(F.col("set").alias("set2"), *apart("node")), "__k0").select("a", "b", "set", "set2")
    links = checkpointed(map_arrow(star, verified, "a long, b long"))

    comp = components(links)
    named = members.where("n > 2").select("band", "n", "node", *apart("node")).join(comp.select("b", *apart("a")), "__k0", "left").select("band", "n", "node", F.coalesce("b", "node").alias("comp"))
    named = checkpointed(named)
    unsettled = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    cells = named.select("n", "node", "comp", "band", *apart("band")).join(unsettled.select(*apart("band")), "__k0").drop("__k0")
    salts = _tiles(F.col("n"))
    own = F.pmod(F.xxhash64("node"), salts).cast("int")
    others = F.filter(F.sequence(F.lit(0), salts - 1), lambda s: (s != own) | (salts == 1))  # a cell of two tiles compares the pairs within each, too
    grid = F.transform(others, lambda s: F.struct(F.least(own, s).alias("lo"), F.greatest(own, s).alias("hi")))
    cells = cells.select("band", "node", "comp", F.explode(grid).alias("s"), *apart("node")).join(sets.select("set", *apart("node")), "__k0").select("band", "s.lo", "s.hi", "node", "comp", "set")

    def across(t: pa.Table) -> pa.Table:
        got = group_links(t["node"].to_pylist(), t["comp"].to_pylist(), [np.frombuffer(x, "u8") for x in t["set"].to_pylist()], p.words)
        give_back()
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([x for _, x in got], pa.int64())})

    more = cells.groupBy("band", "lo", "hi").applyInArrow(across, "a long, b long")
    comp = checkpointed(components(links.unionAll(checkpointed(more))))
    placed = rows.select("doc_id", "th", "node", *apart("node")).join(comp.select("b", *apart("a")), "__k0", "left").select("doc_id", "th", F.coalesce("b", "node").alias("c"))
    placed = checkpointed(placed)
    least = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return placed.select("doc_id", "th", *apart("c")).join(least.select("component_id", *apart("c")), "__k0").select("doc_id", "th", "component_id")
