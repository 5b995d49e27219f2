"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans to theirs.

The field tags tokens as secret begin, inside or outside. A token's scores come from its shape (character classes in runs,
length, mix and entropy of characters), from the two tokens before it and the one after, and from features of the file
(share of digits and of assignment signs, lines). It is trained here, by stochastic gradient descent on the forward-backward
likelihood, in numpy, on windows of at most max_train texts out of about max_seen, those of least hash (documented bounds, as is
that of windows a text); only windows reach the driver. The labels are the spans of the fixed patterns, whose keywords are hidden
in part of the windows, so that shape alone has to do.

Decoding is Viterbi's, exactly, over all tokens of the whole text. A token whose outside score leads by more than transitions
could ever make up is outside on the best path, whatever its neighbours are; between such tokens the best path is found by
dynamic programming, unless no token there makes up for what transitions cost. Scores of words are kept per worker, up to a fixed number of words.

Defined cases: a null or empty text has no spans; spans of one kind don't overlap, those of different kinds may; added spans
(kind crf) keep clear of all base spans; repeated rows get equal results; very long runs are one token, whose features, as a neighbour's too,
count all of it; an empty table trains a field that tags nothing; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, map_arrow, table

KINDS = ("assign", "access", "hex", "crf")
_ANY = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_NAMES = "|".join(map(_ANY, ("password", "passwd", "secret", "token"))) + "|" + _ANY("api") + "_?" + _ANY("key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")
TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]+")
TAGS, BUCKETS, CONTEXT = 3, 1 << 14, 8  # outside, begin, inside
#: Texts to train on, texts to choose them from, and features of a token.
MAX_TRAIN, MAX_SEEN, WIDE = 1500, 20_000, 16
#: Words remembered, new words learned and tokens scored at once, and characters scanned at once (or one text).
MEMO, LEARN, PART, CHARS = 300_000, 50_000, 200_000, 2_000_000
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind, without those that are too short, by start and then kind."""
    low = text.lower()  # at least what has a keyword in either case
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(k in low for k in _HINTS) else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % BUCKETS


class _Signs:
    """By code point, made at first use: the sign of its class (a for letters, A for A-Z, 9 for digits, else itself), and flags: 1 digit, 2 A-Z, 4 a-z, 8 not of [0-9a-f]."""

    def __init__(self) -> None:
        n = 0x110000
        self.sign = np.arange(n, dtype="u4")
        letters = np.char.isalpha(np.arange(n, dtype="u4").view("U1"))
        self.sign[letters] = ord("a")
        self.flag = np.full(n, 8, "u1")
        self.flag[48:58], self.flag[65:91], self.flag[97:123] = 1, 2 | 8, 4 | 8
        self.flag[97:103] = 4
        self.sign[48:58], self.sign[65:91] = ord("9"), ord("A")


_SIGNS: list[_Signs] = []
OwnKey = tuple[str, int]


def own_keys(words: list[str]) -> list[OwnKey]:
    """For each word (none is empty), over all of it: its shape, that is its runs of one class as one sign each, or of many runs only which signs there are, and a
    number that holds length, mix of classes, entropy, whether all is hex, and whether it starts like an access key."""
    if not _SIGNS:
        _SIGNS.append(_Signs())
    signs, flat = _SIGNS[0], np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    n = np.fromiter(map(len, words), "i8", len(words))
    head = np.cumsum(n) - n
    sign = signs.sign[flat]
    new = np.r_[True, sign[1:] != sign[:-1]]
    new[head] = True
    runs = np.add.reduceat(new, head, dtype="i8")
    text = sign[new].astype("<u4").tobytes().decode("utf-32-le")
    at = np.cumsum(runs) - runs
    shape = [text[s : s + k] if k <= 6 else "".join(sorted(set(text[s : s + k])))[:12] + "+" for s, k in zip(at.tolist(), runs.tolist(), strict=True)]
    flags = np.bitwise_or.reduceat(signs.flag[flat], head)
    size = np.frexp(n.astype("f8"))[1].astype("i8")  # bits of the length
    size = np.minimum(12, 2 * size + ((2 * n >> size) & 1))
    # entropy in half bits: sums of c log c over each word's characters, in whole numbers, whatever else is in the batch
    pairs = np.sort((np.repeat(np.arange(len(words)), n) << 21) | flat)
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    count = np.diff(np.r_[first, len(pairs)])
    whole = lambda x: np.rint(x * np.log2(x) * (1 << 20)).astype("i8")
    kinds = np.bincount(pairs[first] >> 21, minlength=len(words))
    spread = whole(n) - np.add.reduceat(whole(count), np.cumsum(kinds) - kinds)
    bits = np.minimum(31, (2 * spread + (n << 4)) // (n << 20))
    access = np.fromiter((w.startswith("AKIA") for w in words), "i8", len(words))
    code = size | (flags & 7).astype("i8") << 4 | bits << 7 | (flags & 8 == 0).astype("i8") << 12 | access << 13
    return list(zip(shape, code.tolist(), strict=True))


def key_features(key: OwnKey) -> list[int]:
    shape, code = key
    size, mix, bits, is_hex, access = code & 15, code >> 4 & 7, code >> 7 & 31, code >> 12 & 1, code >> 13
    return [_bucket("s", shape), _bucket("n", str(size)), _bucket("m", str(mix)), _bucket("mn", f"{mix}.{size}"), _bucket("e", f"{bits}.{mix}"), _bucket("h", f"{is_hex}.{size}"), _bucket("a", str(access))]


#: A word as its neighbours see it: the token before, the one before that, the next.
SEEN = ("-1", "-2", "+1")
_MUL, _ADD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], "u8"), np.array([0x27D4EB2F, 0x165667B1, 0x2545F491], "u8")


def seen_words(words: list[str]) -> np.ndarray:
    """Buckets of words, whatever their case, as each of SEEN."""
    h = np.fromiter((zlib.crc32(w.lower().encode()) for w in words), "u8", len(words))
    return ((h[:, None] * _MUL + _ADD) >> np.uint64(18)).astype("i8") % BUCKETS


def file_features(text: str, n_tokens: int) -> list[int]:
    n = max(1, n_tokens)
    signs = text.count("=") + text.count(":")
    return [_bucket("f=", str(min(5, int(100 * signs / n)))), _bucket("fl", str(min(5, text.count("\n") * 20 // n))), _bucket("f0", "")]


class Field:
    """Weights by feature bucket and tag, and transitions."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo()
        self.rows = np.zeros((1 << 12, 4, TAGS), "f4")  # own, and as each of SEEN
        self.keys: dict[OwnKey, int] = {}
        self.by_key = np.zeros((1 << 10, 4, TAGS), "f4")

    def _key(self, key: OwnKey) -> int:
        """The place in by_key of what words of this key have in common."""
        k = self.keys[key] = len(self.keys)
        if k >= len(self.by_key):
            self.by_key = np.concatenate([self.by_key, np.zeros_like(self.by_key)])
        self.by_key[k, 0] = self.weights[key_features(key)].sum(axis=0)
        for j, kind in enumerate(SEEN, 1):
            self.by_key[k, j] = self.weights[_bucket(kind + "s", key[0])]
        return k

    def _learn(self, new: list[str], k: int) -> None:
        """Scores of new words, all at once, in the rows from k on."""
        known, n = self.keys, len(new)
        keys = [known[x] if x in known else self._key(x) for x in own_keys(new)]
        while k + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k : k + n] = self.by_key[keys]
        self.rows[k : k + n, 1:] += self.weights[seen_words(new)]

    def _places(self, tokens: list[str]) -> np.ndarray:
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        if len(self.memo) > MEMO:
            self._forget()
        k = len(self.memo)
        number, new = self.memo.numbers(coded.dictionary)
        for s in range(0, len(new), LEARN):
            self._learn(new[s : s + LEARN], k + s)
        return number[coded.indices.to_numpy()]

    def emissions(self, tokens: list[list[str]], texts: list[str]) -> np.ndarray:
        """Scores by tag of the tokens of all texts, one text after the other."""
        n = np.fromiter(map(len, tokens), "i8", len(tokens))
        flat = [w for ws in tokens for w in ws]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)  # within the text
        file = np.stack([self.weights[file_features(t, len(ws))].sum(axis=0) for t, ws in zip(texts, tokens, strict=True)])
        e = np.repeat(file, n, axis=0)
        for s in range(0, len(flat), PART):
            lo, end, hi = max(0, s - 2), min(len(flat), s + PART), min(len(flat), s + PART + 1)  # two tokens before and one after count too
            at, k = self._places(flat[lo:hi]), place[lo:hi]
            r = self.rows[at]
            x = r[:, 0].astype("f8")
            x[1:] += r[:-1, 1] * (k[1:, None] >= 1)
            x[2:] += r[:-2, 2] * (k[2:, None] >= 2)
            x[:-1] += r[1:, 3] * (k[1:, None] >= 1)
            e[s:end] += x[s - lo : end - lo]
        return e

    def decode(self, tokens: list[list[str]], texts: list[str]) -> np.ndarray:
        """The best paths' tags, of all texts one after the other."""
        n = sum(map(len, tokens))
        tags = np.zeros(n, "i1")
        if not n:
            return tags
        e = self.emissions(tokens, texts)
        reach = 2 * float(self.trans.max() - self.trans.min())
        lead = e[:, 1:].max(axis=1) - e[:, 0]
        open_ = np.flatnonzero(lead >= -reach)
        if not len(open_):
            return tags
        text = np.repeat(np.arange(len(tokens)), list(map(len, tokens)))
        head = np.r_[0, np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1]
        other = self.trans.copy()
        other[0, 0] = -np.inf
        gain = float(other.max() - self.trans[0, 0])
        # a secret of n tokens takes n + 1 transitions, each better than staying outside by gain at most: its leads must make up for what they cost, or nearly for what they give
        live = np.maximum.reduceat(lead[open_], head) > -gain * (2 if gain > 0 else 1)
        last = open_[np.r_[head[1:], len(open_)] - 1]
        for s, t in zip(open_[head][live].tolist(), (last[live] + 1).tolist(), strict=True):
            best = e[s] + self.trans[0]  # what stands before is outside, or the start
            back = []
            for i in range(s + 1, t):
                step = best[:, None] + self.trans
                back.append(step.argmax(axis=0))
                best = step.max(axis=0) + e[i]
            k = int((best + (self.trans[:, 0] if t < n and text[t] == text[s] else 0)).argmax())
            tags[t - 1] = k
            for i in range(t - 2, s - 1, -1):
                k = int(back[i - s][k])
                tags[i] = k
        return tags


def viterbi(e: np.ndarray, trans: np.ndarray) -> list[int]:
    """The whole dynamic program, for tests."""
    best, back = e[0] + trans[0], []
    for x in e[1:]:
        step = best[:, None] + trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + x
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def tag_tokens(text: str, spans: list[Span]) -> tuple[list[str], np.ndarray]:
    """Tokens, and the tags that the base spans give them: of an assignment only its value counts."""
    found = list(TOKEN.finditer(text))
    secret = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] + [(s, e) for k, s, e in spans if k in ("access", "hex")]
    starts = np.array([m.start() for m in found] or [0])
    tags = np.zeros(len(found), "i1")
    for s, e in secret:
        i, j = max(0, int(np.searchsorted(starts, s, "right")) - 1), int(np.searchsorted(starts, e, "left"))
        own = [k for k in range(i, j) if min(found[k].end(), e) - max(found[k].start(), s) > (found[k].end() - found[k].start()) / 2]
        if own and not tags[own].any():
            tags[own[0]], tags[own[1:]] = 1, 2
    return [m.group() for m in found], tags


def windows(text: str, seed: int = 1, hide: float = 0.6, secrets: int = 8, plain: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most secrets + plain training windows of a text, each 2 * CONTEXT + 1 tokens: around secrets drawn by chance, and around other tokens, half of them the longest
    and half drawn by chance. A window is (features by token, padded with BUCKETS; tags)."""
    tokens, tags = tag_tokens(text, base_spans(text))
    n, size = len(tokens), 2 * CONTEXT + 1
    if n < 4:
        return []
    rng = np.random.default_rng([seed, zlib.crc32(text.encode())])
    outside, secret = np.flatnonzero(tags == 0), np.flatnonzero(tags == 1)
    lengths = np.array([len(t) for t in tokens])
    at = [*rng.permutation(secret)[:secrets], *outside[np.argsort(-lengths[outside], kind="stable")[: plain // 2]], *rng.integers(0, n, plain - plain // 2)]
    file = file_features(text, n)
    out = []
    for c in at:
        lo = max(0, min(int(c) - CONTEXT, n - size))
        ids = range(lo, min(n, lo + size))
        blind = tags[ids.start : ids.stop].any() and rng.random() < hide
        near = tokens[max(0, lo - 2) : lo + size + 1]
        keys, seen, first = own_keys(near), seen_words(near), max(0, lo - 2)
        rows = np.full((len(ids), WIDE), BUCKETS, "u2")
        for a, i in enumerate(ids):
            f = key_features(keys[i - first]) + file
            if not blind:
                for k, (kind, d) in enumerate(zip(SEEN, (-1, -2, 1), strict=True)):
                    if 0 <= i + d < n:
                        f = [*f, _bucket(kind + "s", keys[i + d - first][0]), seen[i + d - first, k]]
            rows[a, : len(f)] = f
        out.append((rows, tags[ids.start : ids.stop]))
    return out


def train(data: list[tuple[np.ndarray, np.ndarray]], seed: int = 1, epochs: int = 6, batch: int = 32, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """On windows."""
    rng = np.random.default_rng(seed)
    weights, trans = np.zeros((BUCKETS, TAGS)), np.zeros((TAGS, TAGS))
    weights[_bucket("f0", ""), 0] = 2.0
    trans[0, 2] = -4.0  # inside doesn't follow outside
    if not any(t.any() for _, t in data):
        weights[_bucket("f0", ""), 0] = 20.0  # nothing to learn from: all is outside
        return Field(weights, trans)
    by: dict[int, list] = {}
    for w in data:
        by.setdefault(len(w[1]), []).append(w)
    sets = [(np.stack([f for f, _ in ws]).astype("i4"), np.stack([t for _, t in ws]).astype("i8")) for ws in by.values()]
    w = np.concatenate([weights, np.zeros((1, TAGS))])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for f, y in sets:
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                k = order[s : s + batch]
                ff, yy = f[k], y[k]
                m, n = yy.shape
                e = w[ff].sum(axis=2)
                a, b = np.empty((n, m, TAGS)), np.zeros((n, m, TAGS))
                lse = lambda x, axis: (mx := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - mx).sum(axis=axis))
                a[0] = e[:, 0] + trans[0]
                for i in range(1, n):
                    a[i] = lse(a[i - 1][:, :, None] + trans, 1) + e[:, i]
                for i in range(n - 2, -1, -1):
                    b[i] = lse(trans[None] + (b[i + 1] + e[:, i + 1])[:, None, :], 2)
                z = lse(a[-1], 1)
                p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2)
                g = -p
                g[np.arange(m)[:, None], np.arange(n)[None], yy] += 1
                t = np.zeros_like(trans)
                for i in range(1, n):
                    q = a[i - 1][:, :, None] + trans + (e[:, i] + b[i])[:, None, :] - z[:, None, None]
                    t -= np.exp(q).sum(axis=0)
                    np.add.at(t, (yy[:, i - 1], yy[:, i]), 1)
                trans += step / m * t
                np.add.at(w, ff.reshape(-1), np.repeat(step / m * g.reshape(-1, TAGS), WIDE, axis=0))
                w[BUCKETS] = 0
        w *= 1 - l2
    return Field(w[:-1], trans)


def added_spans(text: str, base: list[Span], tags: np.ndarray) -> list[Span]:
    """The field's spans that keep clear of the base spans."""
    if not tags.any():
        return []
    found = [m.span() for m in TOKEN.finditer(text)]
    begin = np.flatnonzero((tags == 1) | ((tags == 2) & (np.r_[0, tags[:-1]] == 0)))
    out = []
    for i in begin.tolist():
        j = i + 1
        while j < len(tags) and tags[j] == 2:
            j += 1
        out.append(("crf", found[i][0], found[j - 1][1]))
    if not base:
        return out
    # of base spans by start, the furthest end so far tells whether any of them reaches into a span
    starts = np.array([b[1] for b in base])
    reach = np.maximum.accumulate([b[2] for b in base])
    before = np.searchsorted(starts, [s[2] for s in out])  # base spans that start before the span's end
    return [s for s, k in zip(out, before.tolist(), strict=True) if not k or reach[k - 1] <= s[1]]


def scan(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all its spans."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= CHARS:
            out += _scan(group, field)
            group, size = [], 0
    return out + (_scan(group, field) if group else [])


def _scan(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    tokens = [TOKEN.findall(t) for t in texts]
    tags, at, out = field.decode(tokens, texts), 0, []
    for text, own in zip(texts, tokens, strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + added_spans(text, base, tags[at : at + len(own)]), key=lambda s: (s[1], KINDS.index(s[0])))))
        at += len(own)
    return out


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, max_seen: int = MAX_SEEN) -> Field:
    """Trained on at most max_train distinct texts, the most of them with secrets, of the max_seen or so of least hash; only their windows reach the driver."""
    part = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    n = docs.count()
    least = F.lit(-(1 << 63) + min((1 << 64) - 1, (max_seen << 64) // max(1, n)))  # hashes are even over their range
    seen = part.where(F.col("h") <= least)
    marked = map_arrow(seen, lambda b: {"h": b.column("h"), "secret": [bool(base_spans(t)) for t in b.column("text").to_pylist()]}, "h long, secret boolean").distinct()
    by_hash = sorted((r["h"], r["secret"]) for r in marked.collect())
    some = [h for h, secret in by_hash if secret][: max_train // 2]
    chosen = sorted({*some, *[h for h, _ in by_hash][: max_train - len(some)]})[:max_train]
    if not chosen:
        return train([])

    wanted = pa.array(chosen, pa.int64())

    def fn(b: pa.RecordBatch) -> dict:
        b = b.filter(pc.is_in(b.column("h"), value_set=wanted))
        each = [windows(t) for t in b.column("text").to_pylist()]
        return {"h": b.column("h"), "rows": pa.array([[f.tobytes() for f, _ in x] for x in each], pa.list_(pa.binary())), "tags": pa.array([[t.tobytes() for _, t in x] for x in each], pa.list_(pa.binary()))}

    got = map_arrow(seen, fn, "h long, rows array<binary>, tags array<binary>").groupBy("h").agg(F.first(F.struct("rows", "tags")).alias("w"))
    rows = sorted(got.collect(), key=lambda r: r["h"])
    return train([(np.frombuffer(f, "u2").reshape(-1, WIDE), np.frombuffer(t, "i1")) for r in rows for f, t in zip(r["w"]["rows"], r["w"]["tags"], strict=True)])


def scan_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.trans))
    own: list[Field] = []
    join = lambda spans: ",".join([f"{k}:{s}:{e}" for k, s, e in spans])

    def fn(b: pa.RecordBatch) -> dict:
        if not own:
            own.append(Field(*shared.value))
        got = scan(b.column("text").to_pylist(), own[0])
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in KINDS[:3]}
        return {"doc_id": b.column("doc_id"), "base_sha256": [hashlib.sha256(join(x).encode()).hexdigest() for x, _ in got], "spans": [join(x) for _, x in got]} | counts

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, fit(docs))
