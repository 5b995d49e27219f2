"""SimHash of shingle sets at a wide radius: which texts may be similar at 0.8 or more, by bands of long fingerprints and Hamming distance.

A set becomes a fingerprint of some hundred bits, the majority of its shingles' bits; each bit has a random hash of its own. At a similarity of 0.8
two sets agree in a bit with probability 0.8385 at least (four shingles against five: 0.8125, so sets of up to five take further bands among themselves, with a
wider radius; enumerated up to 160 common shingles, beyond which it approaches 0.8485). In 64 bits that is a distance of ten, with a tail beyond twenty, which no blocks can search. So a fingerprint goes to the groups of
its bands, k bits each, of as many bands as make a pair miss all of them with probability MISS at most. Within a group numpy compares all
fingerprints by their first CHECK bits: what RADIUS joins is a piece. At 0.8 those bits differ in more than RADIUS with probability below 2.5e-6. No pair
within the radius that shares a group is lost; what a piece holds is held to the sets themselves by shingle_sets.

k grows with the number of fingerprints, so that groups stay small at any size, and the bands with k. In a group far above that size, as many near copies of one
text make, what lies within half the radius of one fingerprint is one piece without more comparisons, and meets only what lies within one and a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow
from .components import hooked

CHECK, MISS, PER_GROUP, TILE = 192, 7e-6, 2048, 8192
AGREE, RADIUS = 0.8385, 57
SMALL, AGREE_SMALL, RADIUS_SMALL = 5, 0.8125, 62


class Plan(NamedTuple):
    """Bits of a band, bands of a set, further bands of a set of up to SMALL shingles, and 64-bit words of a fingerprint."""

    k: int
    bands: int
    small: int
    words: int


def plan(n: int) -> Plan:
    """The fewest bits a band that make groups of about PER_GROUP out of n fingerprints; they change the cost alone."""
    k = max(1, ceil(log(max(n, 1) / PER_GROUP, 2)))
    bands, small = (ceil(log(MISS) / log1p(-(p**k))) for p in (AGREE, AGREE_SMALL))
    return Plan(k, bands, small, ceil(max(CHECK, small * k) / 64))


@lru_cache
def _constants(words: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, (3, words), "u8") * np.uint64(2) + np.uint64(1)


def bit_hashes(s: np.ndarray, words: int) -> np.ndarray:
    """For each shingle hash a row of words, whose bits are random ones."""
    xor, mul, mul2 = _constants(words)
    h = (s[:, None] ^ xor) * mul
    h ^= h >> np.uint64(32)
    h *= mul2
    h ^= h >> np.uint64(29)
    return h


def fingerprint(s: np.ndarray, words: int) -> bytes:
    """A bit is 1 if it is set in over half of the shingles."""
    ones = np.zeros(64 * words, "i8")
    for i in range(0, len(s), 255):
        ones += np.unpackbits(bit_hashes(s[i : i + 255], words).view("u1"), axis=1, bitorder="little").sum(axis=0, dtype="u1")
    return np.packbits(2 * ones > len(s), bitorder="little").tobytes()


def _distances(f: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(cols)), "u1")
    for x in f:
        out += np.bitwise_count(x[rows, None] ^ x[None, cols])
    return out


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = hooked(label[i], label[j])
    up = np.arange(len(label))
    up[a] = b
    return up[label]


def pieces(f: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """f: a row for each word, a column for each fingerprint. For each fingerprint the least index of its piece, that links within the radius join."""
    label, left = np.arange(f.shape[1]), np.arange(f.shape[1])
    while len(left) > tile:
        d = _distances(f, left[:1], left)[0]
        ball, ring = left[d <= radius // 2], left[(d > radius // 2) & (d <= radius + radius // 2)]
        if len(ball) > 1:
            label = _joined(label, np.broadcast_to(ball[:1], len(ball)), ball)
        for s in range(0, len(ball), 256):
            ring = ring[label[ring] != label[ball[0]]]
            for t in range(0, len(ring), tile):
                cols = ring[t : t + tile]
                hit = cols[(_distances(f, ball[s : s + 256], cols) <= radius).any(axis=0)]
                if len(hit):
                    label = _joined(label, np.broadcast_to(ball[:1], len(hit)), hit)
        left = left[d > radius // 2]
    for s in range(0, len(left), 256):
        rows, cols = left[s : s + 256], left[s:]
        i, j = ((_distances(f, rows, cols) <= radius) & (label[rows, None] != label[None, cols])).nonzero()
        if len(i):
            label = _joined(label, rows[i], cols[j])
    return label


def near_pieces(nodes: DataFrame, p: Plan) -> DataFrame:
    """nodes(node, fp, small), fingerprints that are distinct by node, to (band, root, node): the pieces of two or more of every group, and a node of each as its root."""

    def keyed(b: pa.RecordBatch) -> dict:
        n = b.num_rows
        fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), "u1").reshape(n, 8 * p.words)
        bits = np.unpackbits(fp, axis=1, bitorder="little")[:, : p.small * p.k].reshape(n, p.small, p.k)
        band = np.arange(p.bands + p.small)  # those from p.bands on hold the same bits, of small sets alone
        value = bits @ (1 << np.arange(p.k))
        key = np.concatenate([value[:, : p.bands], value], axis=1) + (band << 40)
        on = (band < p.bands) | b.column("small").to_numpy(zero_copy_only=False)[:, None]
        at = on.nonzero()[0]
        f = fp[:, : CHECK // 8].copy().view("i8")
        return {"key": key[on], "node": b.column("node").to_numpy()[at]} | {f"f{w}": f[at, w] for w in range(CHECK // 64)}

    fs = [f"f{w}" for w in range(CHECK // 64)]
    rows = map_arrow(nodes.select("node", "fp", "small"), keyed, ", ".join(f"{c} long" for c in ("key", "node", *fs)))
    rows = rows.repartition("key").sortWithinPartitions("key")

    def found(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, *f = np.concatenate(held, axis=1)
        label = pieces(np.stack(f).view("u8"), RADIUS if key[0] >> 40 < p.bands else RADIUS_SMALL)
        on = np.bincount(label, minlength=len(label))[label] > 1
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (key, node[label], node)], ["key", "root", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last group may go on in the next batch
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in ("key", "node", *fs)])
            for part in np.split(x, np.flatnonzero(x[0, 1:] != x[0, :-1]) + 1, axis=1):
                if held and part.shape[1] and held[0][0, 0] != part[0, 0]:
                    yield from found(held)
                    held = []
                if part.shape[1]:
                    held.append(part)
        if held:
            yield from found(held)
        give_back()

    return rows.mapInArrow(run, "key long, root long, node long").select(F.xxhash64("key", "root").alias("band"), "root", "node")
