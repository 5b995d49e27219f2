"""Quality rules with risk-controlled thresholds.

Fixed base rules (word count, repeated windows) reject first. Beyond them, six ratios of a text are held against upper
cutoffs, fitted per stratum (lang) on the labelled documents that pass the base: cutoffs may stand only if an exact
binomial (Clopper-Pearson) bound says that, but for the error level, together they reject at most a given share of the good documents
of their stratum. One fixed sequence tightens the six, a grid step of one ratio at a time, all from lenient to strict alike, and stops
at the first step whose union of cutoffs fails (fixed-sequence testing needs no correction along the walk); over strata alone the error
level is split evenly (Bonferroni).
So with probability 1 - delta, in every stratum the six cutoffs together reject at most alpha of the good documents.
Counts per stratum and step are sums over all labelled documents; only that table reaches the driver.
A stratum with too few labels certifies nothing and rejects nothing beyond the base.

Defined cases: a null or empty text has no words and fails the base; a null lang is a stratum of its own; null labels
don't count, repeated labels count each; a document without doc_id is judged like any other; a stratum unseen in the labels keeps all; texts of any length
count whole; a ratio equal to its cutoff stays; repeated rows get equal verdicts; empty tables give no rows and no cutoffs; other columns are left out, whatever their
names, or kept by the stage.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, map_arrow, slices, small_batches, table

_WS, _SYM = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MIN_WORDS = 50
#: Ratio and its grid, from lenient to strict; a document is rejected above the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbols": [2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06, 0.03],
    "repeats": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "dup_lines": [0.9, 0.75, 0.6, 0.5, 0.4, 0.35],
    "capitals": [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "word_length": [14.0, 12.0, 10.0, 9.0, 8.0, 7.0],
    "sameness": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7],
}
#: (ratio, cutoff) in the order in which they are tested: by the share of the ratio's grid that is used up.
STEPS = [(f, c) for _, f, c in sorted(((i + 1) / len(g), f, c) for f, g in GRIDS.items() for i, c in enumerate(g))]
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{x} long" for x in _BASE) + ", " + ", ".join(f"{x} double" for x in GRIDS)


def text_features(text: str | None) -> tuple:
    """The base counts, then the six ratios."""
    b = (text or "").encode()
    w = b.split()  # on the six ASCII white spaces
    n = len(w)
    if not n:
        return (0,) * len(_BASE) + (0.0,) * len(GRIDS)
    chars = len(text) - (len(b) - len(b.translate(None, _WS)))
    symbols = len(b) - len(b.translate(None, _SYM))
    lines = [x for x in b.split(b"\n") if x.strip(_WS)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        h = np.fromiter(map(hash, w), "i8", n).view("u8")
        g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        g.sort()
        if (g[1:] == g[:-1]).any():  # else no window repeats; the count itself is exact
            tri = list(zip(w, w[1:], w[2:], strict=False))
            c = Counter(tri)
            hit = np.zeros(n, bool)
            at = np.fromiter((c[x] > 1 for x in tri), bool, n - 2)
            hit[:-2] |= at
            hit[1:-1] |= at
            hit[2:] |= at
            repeat = int(hit.sum())
    upper = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (n, chars, symbols, dup, repeat, symbols / n, repeat / n, dup / len(lines), upper / max(1, chars), chars / n, 1 - len(set(w)) / n if n >= 200 else 0.0)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, counts, ratios) of each whole text."""

    def fn(b: pa.RecordBatch) -> dict:
        cols = list(zip(*map(text_features, b.column("text").to_pylist()), strict=True))
        return {"doc_id": b.column("doc_id"), "lang": b.column("lang")} | dict(zip([*_BASE, *GRIDS], map(list, cols), strict=True))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), fn, "doc_id long, lang string, " + _SCHEMA)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_cdf(k: int, n: int, p: float) -> float:
    """ln P(X <= k), X binomial, for p of k / n or more: terms fall from that of k downwards, and are summed until they vanish."""
    if k >= n:
        return 0.0
    if p >= 1:
        return -math.inf
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0.0) + (n - k) * math.log1p(-p)
    i = np.arange(k, max(0, k - 1000 - 40 * math.isqrt(n)), -1)
    below = np.cumsum(np.log(i / (n - i + 1)) + math.log1p(-p) - math.log(p)) if k else i
    return top + math.log1p(float(np.exp(below).sum()))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact one-sided upper bound of a share, k of n seen, at error level delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _log_cdf(k, n, mid) > math.log(delta) else (lo, mid)
    return hi


def fit_cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and ratio, from feats (of features()) and labels(doc_id, quality)."""
    held = feats.where(~base_failed()).join(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long")), "doc_id")
    step = F.lit(len(STEPS))  # the first step that rejects a document
    for k, (f, c) in reversed(list(enumerate(STEPS))):
        step = F.when(F.col(f) > c, k).otherwise(step)
    counts: dict[str | None, Counter] = {}
    for r in held.groupBy("lang", step.alias("step")).count().collect():  # at most len(STEPS) + 1 rows for each stratum
        counts.setdefault(r["lang"], Counter())[r["step"]] = r["count"]
    level = delta / max(1, len(counts))
    out: dict[str | None, dict[str, float]] = {}
    for lang, by_step in counts.items():
        own: dict[str, float] = {}
        n, hit = by_step.total(), 0
        for k, (f, c) in enumerate(STEPS):
            hit += by_step[k]
            if binomial_upper(hit, n, level) > alpha:
                break
            own[f] = c
        out[lang] = own
    return out


def rejected(cutoffs: dict[str | None, dict[str, float]]) -> F.Column:
    out = F.lit(False)
    for lang, own in cutoffs.items():
        for f, c in own.items():
            out |= F.col("lang").eqNullSafe(F.lit(lang)) & (F.col(f) > c)
    return out


def judge(feats: DataFrame, cutoffs: dict) -> DataFrame:
    return feats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept; texts are read twice and never shuffled."""
    cutoffs = fit_cutoffs(features(docs), labels, alpha, delta)
    names = list(GRIDS)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            keep = []
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                x = text_features(t)
                own = cutoffs.get(lang, {})
                bad = x[0] < MIN_WORDS or 100 * x[4] > 50 * x[0] or any(v > own[f] for f, v in zip(names, x[5:], strict=True) if f in own)
                keep.append(not bad)
            give_back()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = checkpointed(features(table(spark, sf_dir, "documents")))  # counts alone, no texts
    out = judge(feats, fit_cutoffs(feats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *_BASE, "base_failed", "kept")


#: The whole query: counts and ratios by patterns and lists; a document's first step that rejects it; per stratum the steps whose union of cutoffs passes
#: the exact test, a binomial sum against the error level, until one fails.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
tri AS (SELECT r, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) > 2)),
twice AS (SELECT r, a, b, c FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT s + o) AS n FROM tri JOIN twice USING (r, a, b, c), range(3) q(o) GROUP BY r),
n AS (SELECT w.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_kinds
      FROM w LEFT JOIN rep ON w.r = rep.r),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n),
v AS (SELECT r, 'symbols' AS f, n_symbols / n_words AS v FROM f WHERE n_words > 0 UNION ALL SELECT r, 'repeats', n_repeat_words / n_words FROM f WHERE n_words > 0
      UNION ALL SELECT r, 'dup_lines', n_dup_lines / n_lines FROM f WHERE n_words > 0 UNION ALL SELECT r, 'capitals', n_upper / word_chars FROM f WHERE n_words > 0
      UNION ALL SELECT r, 'word_length', word_chars / n_words FROM f WHERE n_words > 0 UNION ALL SELECT r, 'sameness', 1 - n_kinds / n_words FROM f WHERE n_words >= 200),
steps(k, f, c) AS (VALUES {", ".join(f"({k}, '{f}', {c!r}e0)" for k, (f, c) in enumerate(STEPS))}),
first AS (SELECT r, min(k) AS k FROM v JOIN steps ON v.f = steps.f AND v.v > steps.c GROUP BY r),
good AS (SELECT f.lang, coalesce(first.k, {len(STEPS)}) AS k FROM f JOIN labels ON f.doc_id = labels.doc_id AND labels.quality = 1 LEFT JOIN first ON f.r = first.r WHERE NOT base_failed),
size AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
hits AS (SELECT size.lang, any_value(n) AS n, steps.k, count(good.k) AS hit FROM size CROSS JOIN steps LEFT JOIN good ON good.lang IS NOT DISTINCT FROM size.lang AND good.k <= steps.k GROUP BY size.lang, steps.k),
tail AS (SELECT lang, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02e0) + (n - i) * ln(0.98e0))) AS p FROM hits, range((SELECT max(hit) FROM hits) + 1) q(i) WHERE i <= hit GROUP BY lang, k),
certified AS (SELECT lang, coalesce(min(k) FILTER (WHERE p > 0.05e0 / (SELECT count(*) FROM size)), {len(STEPS)}) AS n FROM tail GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(first.k, {len(STEPS)}) >= coalesce(certified.n, 0) AS kept
FROM f LEFT JOIN first ON f.r = first.r LEFT JOIN certified ON f.lang IS NOT DISTINCT FROM certified.lang
"""
