"""Each query, and the pipeline, over whole tables: against DuckDB where SQL can express it, else against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from veldt.llm import quality, secret_scan
from veldt.llm.queries import ORACLE_SQL, QUERIES

from .made import groups
from .test_lines_shards_packing import dedup_by_hand
from .test_models_and_urls import base_by_hand
from .test_near_and_leaks import LOWER, fingerprint_by_hand, leaks_by_hand


def rows_of(spark, sf, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*cols).collect()]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall())


def pieces_by_hand(rows):
    out = []
    for i, t in rows:
        ids = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            out.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check_packing(got, pieces):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(p[3] for p in pieces) // 2048) + 1


def test_packing(spark, sf):
    check_packing(QUERIES["op2_best_fit_packing"](spark, sf).collect(), pieces_by_hand(rows_of(spark, sf, "documents", "doc_id", "text")))


def shard_by_hand(doc_id, n):
    """The highest of n scores -1 / ln(u), u from 53 bits of XXH64 over (doc_id, shard)."""
    seed = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    u = [((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed) >> 11) + 0.5) / 2**53 for s in range(n)]
    return max(range(n), key=lambda s: (-1.0 / math.log(u[s]), -s))


def test_sharding(spark, sf):
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", shard_by_hand(i, 40), shard_by_hand(i, 41)) for i, t in rows_of(spark, sf, "documents", "doc_id", "text")}
    slots = defaultdict(list)
    got = {}
    for r in QUERIES["op3_sharding"](spark, sf).collect():
        got[r["doc_id"]] = (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"])
        slots[r["shard"]].append(r["slot"])
    assert got == want and all(sorted(v) == list(range(len(v))) for v in slots.values())


def quality_by_hand(docs, labels, alpha=0.02, delta=0.05):
    """doc_id -> (base counts, base_failed, kept): ratios from whole texts, and cutoffs by their definition, with binomial sums in whole numbers of terms."""
    rows = {}
    for i, t, lang in docs:
        n, chars, symbols, dup, repeat = base_by_hand(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = dict.fromkeys(quality.GRIDS, 0.0)
        if n:
            upper = sum("A" <= c <= "Z" for c in t)
            r = {"symbols": symbols / n, "repeats": repeat / n, "dup_lines": dup / len(lines), "capitals": upper / chars, "word_length": chars / n, "sameness": 1 - len(set(w)) / n if n >= 200 else 0.0}
        rows[i] = (lang, (n, chars, symbols, dup, repeat), n < 50 or 100 * repeat > 50 * n, r)
    good = defaultdict(list)
    for i, q in labels:
        if q == 1 and i in rows and not rows[i][2]:
            good[rows[i][0]].append(rows[i][3])
    cutoffs = defaultdict(list)
    for lang, own in good.items():
        for f, c in quality.STEPS:
            hit = sum(any(r[g] > d for g, d in [*cutoffs[lang], (f, c)]) for r in own)
            n = len(own)
            if sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(hit + 1)) > delta / len(good):  # too likely, were the share alpha
                break
            cutoffs[lang].append((f, c))
    return {i: (base, failed, not failed and not any(r[f] > c for f, c in cutoffs[lang])) for i, (lang, base, failed, r) in rows.items()}, dict(cutoffs)


def test_quality_rules(spark):
    """At sf0.1, where every stratum has labels enough; the cutoffs reject most bad documents there and hardly any good one."""
    sf = "/root/testdata/sf0.1"
    labels = rows_of(spark, sf, "labels", "doc_id", "quality")
    want, cutoffs = quality_by_hand(rows_of(spark, sf, "documents", "doc_id", "text", "lang"), labels)
    got = {r["doc_id"]: ((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]) for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    assert got == want
    assert len(cutoffs) == 4 and all(len(v) > 30 for v in cutoffs.values())
    good, bad = ([want[i][2] for i, q in labels if q == k and i in want and not want[i][1]] for k in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_secret_scans(spark, sf):
    patterns = {
        "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    }
    order = list(patterns)
    got = {r["doc_id"]: r for r in QUERIES["op6_secret_scans"](spark, sf).collect()}
    docs = rows_of(spark, sf, "documents", "doc_id", "text")
    assert len(got) == len(docs)
    field = secret_scan.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    for i, t in docs:
        base = [(k, *m.span()) for k, (p, flags, ok) in patterns.items() for m in re.finditer(p, t or "", flags) if ok(m)]
        base.sort(key=lambda s: (s[1], order.index(s[0])))
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in order)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        # the added spans by the whole dynamic program
        tokens = list(secret_scan.TOKEN.finditer(t or ""))
        tags = secret_scan.viterbi(field.emissions([[m.group() for m in tokens]], [t]), field.trans) if tokens else []
        spans = []
        for k, tag in enumerate(tags):
            if tag == 2 and k and tags[k - 1]:
                spans[-1] = ("crf", spans[-1][1], tokens[k].end())
            elif tag:
                spans.append(("crf", *tokens[k].span()))
        spans = base + [s for s in spans if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
        spans.sort(key=lambda s: (s[1], [*order, "crf"].index(s[0])))
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    docs = {i: (t, x) for i, t, x in rows_of(spark, sf, "documents", "doc_id", "text", "lang")}
    got = QUERIES["op7_language_id"](spark, sf).collect()
    learned = {x for i, (_, x) in docs.items() if x and zlib.crc32(str(i).encode()) % 5}
    right = []
    assert len(got) == len(docs)
    for r in got:
        t, x = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not t or not any(map(str.isalpha, t))) and r["lang_pred"] in learned | {"und"}
        if r["held_out"] and x and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == x)
    assert len(right) > 100 and np.mean(right) > 0.97


def test_simhash(spark, sf):
    fp = {i: fingerprint_by_hand(t) for i, t in rows_of(spark, sf, "documents", "doc_id", "text")}
    comp = groups(sorted(fp), [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_near_dedup"](spark, sf).collect()} == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = rows_of(spark, sf, "documents", "doc_id", "text", "lang")
    judged, _ = quality_by_hand(docs, rows_of(spark, sf, "labels", "doc_id", "quality"))
    left = [(i, t) for i, t, _ in docs if judged[i][2]]
    # lines
    strip = " \t\n\x0b\x0c\r"
    where = defaultdict(set)
    key = lambda x: x.strip(strip).translate(LOWER)
    for i, t in left:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                where[key(x)].add(i)
    gone = {k: min(v) for k, v in where.items() if len(v) > 1}
    texts = {i: t and "\n".join(x for x in t.split("\n") if not (key(x) in gone and i > gone[key(x)])) for i, t in left}
    assert [x[3] for x in dedup_by_hand(left)] == [hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, *_ in dedup_by_hand(left)]
    # near copies
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    comp = groups(sorted(sets), [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    kept = [(i, texts[i]) for i in sorted(texts) if comp[i] == i]
    # passages
    items = rows_of(spark, sf, "benchmark", "item_id", "text")
    clean = {r[0] for r in leaks_by_hand(kept, items) if not r[-1]}
    assert 0 < len(clean) < len(kept) < len(left) < len(docs)
    check_packing(corpus_pipeline.run(spark, sf).collect(), pieces_by_hand([(i, t) for i, t in kept if i in clean]))


def test_spread_of_counts():
    """The pieces of brute force above are checked themselves on a text of known length."""
    got = pieces_by_hand([(1, "a " * 5000), (2, None)])
    assert Counter(r[0] for r in got) == {1: 3, 2: 1} and got[-1][3] == 1
