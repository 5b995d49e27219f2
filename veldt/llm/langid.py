"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its words (marked at both ends, A-Z lower-cased) and their character n-grams of 2 to 4, hashed into buckets;
their embeddings are averaged and a linear softmax over the learned languages follows. Embeddings and weights are trained by
stochastic gradient descent in numpy on the driver, on max_train labelled rows (a documented bound; the rows of least hash), of which only the
counts by bucket reach it: a bounded number of bytes a row, however long its text. A temperature, fitted on a part of those rows that training
leaves out, calibrates the score, and the score below which 2 % of that part's right answers lie is the rejection threshold.

In prediction Arrow tells the words of a batch apart; each word's summed logits are computed once per worker, those of all new words of a batch
at once, and remembered up to a fixed number of words; every word of the whole text counts. Words of any length are taken in stretches of bounded size.

Defined cases: und with score 0 for a null text or one without a letter; without any labelled row all are und with score 0; equal
logits go to the first language in text order; a document that is held out (by doc_id) never trains, nor does one without doc_id; repeated rows
may train twice; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_MAX, Memo, map_arrow, table

BUCKETS, DIM, MAX_TRAIN, EPOCHS = 1 << 15, 16, 2000, 8
#: Characters and words looked at in one go.
STRETCH, PART = 1 << 18, 1 << 18
#: Numbers that are remembered of words.
SUMS = 8_000_000
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], "u8")
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def grams(words: list[str]):
    """Yields (word's number, bucket) of all subwords, in arrays: each word itself, and its n-grams of 2 to 4 characters, marked at both ends."""
    own = np.fromiter((zlib.crc32(w.encode()) for w in words), "u8", len(words))
    yield np.arange(len(words)), (own * _MUL[0] >> _SHIFT).astype("i8")
    flat = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4")
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), "i8", len(words)) + 2)
    for s in range(0, len(flat), STRETCH):
        c, k = flat[s : s + STRETCH + 3].astype("u8"), word[s : s + STRETCH + 3]
        h = c * _MUL[1]
        for n in (2, 3, 4):
            m = min(STRETCH, len(c) - n + 1)  # n-grams that start in this stretch
            if m > 0:
                h = (h[:m] ^ (h[:m] >> np.uint64(29))) * _MUL[2] + c[n - 1 : n - 1 + m] * _MUL[3]
                inside = k[:m] == k[n - 1 : n - 1 + m]
                yield k[:m][inside], (h * _MUL[0] >> _SHIFT)[inside].astype("i8")


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, and the place where each text's words begin (and the last ones end). White space at an end makes an empty word."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = cut.offsets.to_numpy()
    return cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode(), ends - ends[0]


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text, and each one's share of all subwords."""
    coded, _ = split_words(pa.array([text], pa.string()))
    words = coded.dictionary.to_pylist()
    often = np.bincount(coded.indices.to_numpy(), minlength=len(words)) * np.array([bool(w) for w in words], "i8")
    total = np.zeros(BUCKETS)
    for k, b in grams(words):
        total += np.bincount(b, often[k], BUCKETS)
    at = np.flatnonzero(total)
    return at.astype("u2"), (total[at] / max(1, total.sum())).astype("f4")


class Model:
    def __init__(self, langs: list[str], table_: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.temperature, self.reject_below = langs, table_, temperature, reject_below
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo()
        self.sums = np.zeros((1 << 12, len(self.langs) + 1), "f4")  # logits, and how many subwords

    def _learn(self, new: list[str], k: int) -> None:
        """Fills the rows from k on."""
        n = len(new)
        while k + n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        total = np.zeros((n, len(self.langs) + 1))
        for w, b in grams(new):
            for c in range(len(self.langs)):
                total[:, c] += np.bincount(w, self.table[b, c], n)
            total[:, -1] += np.bincount(w, minlength=n)
        total[[not w for w in new]] = 0  # what stands for white space at an end
        self.sums[k : k + n] = total

    def logits(self, texts: pa.Array) -> np.ndarray:
        """A row a text."""
        coded, ends = split_words(texts)
        if len(self.memo) > min(MEMO_MAX, SUMS // (len(self.langs) + 1)):
            self._forget()
        k = len(self.memo)
        number, new = self.memo.numbers(coded.dictionary)
        s, size = 0, 0
        for e, w in enumerate(new, 1):
            size += len(w)
            if size >= STRETCH or e == len(new):
                self._learn(new[s:e], k + s)
                s, size = e, 0
        rows = number[coded.indices.to_numpy()]
        total = np.zeros((len(texts), len(self.langs) + 1))
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        for s in range(0, len(rows), PART):
            r, t = self.sums[rows[s : s + PART]], text[s : s + PART]
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(t, r[:, c], len(texts))
        return total[:, :-1] / np.maximum(total[:, -1:], 1)

    def predict(self, texts: pa.Array | list[str | None]) -> list[tuple[str, float]]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = p.max(axis=1) / p.sum(axis=1)
        letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
        return [(self.langs[k], s) if ok else ("und", 0.0) for k, s, ok in zip(best.tolist(), score.tolist(), letter, strict=True)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 1, epochs: int = EPOCHS, batch: int = 32) -> Model:
    """On bucket_counts and their languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), "f4"), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(rows))
    aside, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    if not len(fit):
        fit = order
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype("f4")
    out = np.zeros((DIM, len(names)), "f4")

    def softmax(z):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def averaged(ks):
        return np.stack([v @ emb[i] for i, v in (rows[k] for k in ks)])

    for epoch in range(epochs):
        rate = 20.0 * (1 - epoch / epochs)
        mixed = rng.permutation(fit)
        for s in range(0, len(mixed), batch):
            ks = mixed[s : s + batch]
            h = averaged(ks)
            g = softmax(h @ out)
            g[np.arange(len(ks)), y[ks]] -= 1
            back = g @ out.T
            out -= rate / len(ks) * h.T @ g / 4
            for r, k in enumerate(ks):
                i, v = rows[k]
                emb[i] -= rate / len(ks) * v[:, None] * back[r]
    held = aside if len(aside) >= 20 else fit
    z = averaged(held) @ out
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return Model(names, emb @ out, temperature, float(np.quantile(right, 0.02)) if len(right) else 0.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Trained on the max_train labelled rows of least hash that are not held out."""
    part = docs.where(~held_out() & F.col("lang").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    least = part.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]  # no text is read
    if least is None:
        return train([], [])

    def fn(b: pa.RecordBatch) -> dict:
        each = [bucket_counts(t) for t in b.column("text").to_pylist()]
        return {c: b.column(c) for c in ("h", "doc_id", "lang")} | {"at": pa.array([x.tobytes() for x, _ in each], pa.binary()), "share": pa.array([x.astype("f2").tobytes() for _, x in each], pa.binary())}

    got = map_arrow(part.where(F.col("h") <= least).where("text is not null"), fn, "h long, doc_id long, lang string, at binary, share binary")
    rows = sorted((tuple(r) for r in got.orderBy("h", "doc_id", "lang", "at", "share").limit(max_train).collect()), key=lambda r: (r[1], r[2], r[3]))
    return train([(np.frombuffer(a, "u2"), np.frombuffer(v, "f2").astype("f4")) for _, _, _, a, v in rows], [r[2] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.temperature, model.reject_below))
    own: list[Model] = []

    def fn(b: pa.RecordBatch) -> dict:
        if not own:
            own.append(Model(*shared.value))
        got = own[0].predict(b.column("text"))
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": [x for x, _ in got], "score": [x for _, x in got], "rejected": [s < own[0].reject_below for _, s in got]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), fn, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
