"""Benchmark decontamination, native: a positional index of the documents' tokens, searched for the items' windows.

A window is 10 consecutive words of an item (all of them in a shorter item). Each document is tokenised once, into a stored table with a row a document:
its words by position, and their number. That is the index, partitioned by document: the postings of a word are the places that the table
unfolds to, and a document's lists lie in its own row. The postings of the words that occur in windows are counted; each window is then looked up
by its rarest word, and the postings of that word, adjusted by its offset, are intersected with those of the second rarest and then of all other
words, by looking at the offset-adjusted places in the same row, so that no posting is shuffled. Windows with a word that no document has are
dropped before. Frequent words are never looked up unless a window has no rarer one, and a frequent passage costs a row for each place.

Windows are numbered, and the items that hold a window stay in a table of their own, which the places found meet once a document and window. The tables of
window words, counts and windows are broadcast only up to max_broadcast bytes, measured before; beyond, words are counted before they meet the
windows' words, postings and windows are joined by word, with adaptive splitting of frequent words, and the places found, with their windows' SHA-256, are
verified in their document.

Defined cases: null and empty texts have no words; items without words have no window; repeated items count each by
item_id; items with a null item_id count in the pipeline's stage, which asks for passages alone, and not in op9, whose SQL leaves
them out; rows that share a doc_id are told apart by a hash of the text; without documents or items nothing is found; other columns are left out, whatever
their names, or kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, checkpointed, free_name, stored, table

WINDOW, MAX_BROADCAST = 10, 16 << 20
#: What is not in [\x00-\x2F\x3A-\x60\x7B-\x7F], named by what it holds, letters first: Java's matcher is ten times as fast then.
_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, n: int = WINDOW, unnamed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, win): each distinct window; (id, items): the item_ids that hold it. unnamed: also windows of null item_ids, with no id for them."""
    w = (items if unnamed else items.where("item_id is not null")).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(n), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    rows = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("win"))
    both = checkpointed(rows.groupBy("win").agg(F.collect_set("item_id").alias("items")).select(F.monotonically_increasing_id().alias("id"), "win", "items"))
    return both.select("id", "win"), both.select("id", "items")


def _sized(df: DataFrame, max_broadcast: int) -> DataFrame:
    """df, to be broadcast if its rows, as text, are small enough."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_broadcast else df


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, w): the stored words of each document by position; th is a hash of its text."""
    return stored(docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "w"))


def postings(idx: DataFrame) -> DataFrame:
    """(doc_id, th, w, pos, word): every posting, beside its document's words."""
    return idx.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word"))


def frequencies(idx: DataFrame, windows: DataFrame, max_broadcast: int) -> DataFrame:
    """(word, df): postings of each window word."""
    vocabulary = checkpointed(windows.select(F.explode("win").alias("word")).distinct())
    own = idx.select(F.explode("w").alias("word"))
    sized = _sized(vocabulary, max_broadcast)
    if sized is vocabulary:  # too large: all words are counted first, so that a frequent one is a row a task
        return own.groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word")
    return own.join(sized, "word").groupBy("word").agg(F.count("*").alias("df"))


def anchors(windows: DataFrame, freq: DataFrame, max_broadcast: int) -> DataFrame:
    """(word, at, word2, at2, len, id, win): each window that may occur by its rarest word and the next, with their offsets."""
    freq = _sized(checkpointed(freq), max_broadcast)
    terms = windows.select("id", F.posexplode("win").alias("at", "word")).join(freq, "word", "left")
    each = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "word")))
    t = terms.groupBy("id").agg(each.alias("t")).where(F.col("t")[0]["df"] > 0)
    second = F.element_at("t", F.least(F.lit(2), F.size("t")))
    of = t.select("id", F.col("t")[0]["word"].alias("word"), F.col("t")[0]["at"].alias("at"), second["word"].alias("word2"), second["at"].alias("at2"))
    return of.join(windows, "id").select("word", "at", "word2", "at2", F.size("win").alias("len"), "id", "win")


def occurrences(idx: DataFrame, windows: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, th, start, len, id): each place where a window occurs word for word."""
    known = checkpointed(anchors(windows, frequencies(idx, windows, max_broadcast), max_broadcast))
    start = F.col("pos") - F.col("at")
    sized = _sized(known, max_broadcast)
    if sized is not known:
        found = postings(idx).join(sized, "word").where((start >= 0) & (start + F.col("len") <= F.size("w")))
        here = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len"))  # valid in whatever order the conditions are taken
        found = found.where((F.get("w", start + F.col("at2")) == F.col("word2")) & (here == F.col("win")))
        return found.select("doc_id", "th", start.alias("start"), "len", "id")
    # postings are shuffled by word without their documents' words, which meet a document's places once
    digest = lambda win: F.unhex(F.sha2(F.array_join(win, " "), 256))
    short = known.select("word", "at", "len", "id", digest(F.col("win")).alias("sha"))
    may = postings(idx).select("doc_id", "th", "pos", "word").join(short, "word").where(start >= 0)
    may = may.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set(F.struct(start.alias("start"), "len", "id", "sha")).alias("c"))
    both = idx.select("doc_id", "th", "w").join(may, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    hit = F.filter("c", lambda x: digest(F.slice("w", x["start"] + 1, x["len"])) == x["sha"])
    return both.select("doc_id", "th", F.explode(hit).alias("x")).select("doc_id", "th", "x.start", "x.len", "x.id")


def proximity(docs: DataFrame, items: DataFrame, slop: int = 5, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, th, pos, items): places of a window's rarest word that some len + slop consecutive words of the document hold with all its words, in any order."""
    idx = index(docs)
    windows, holders = item_windows(items, n)
    known = _sized(checkpointed(anchors(windows, frequencies(idx, windows, max_broadcast), max_broadcast)), max_broadcast)
    span = F.col("len") + slop
    first = F.greatest(F.col("pos") - span + 1, F.lit(0))
    around = F.slice("w", first + 1, F.col("pos") - first + span)
    whole = F.exists(F.sequence(first, F.col("pos")), lambda s: F.size(F.array_except("win", F.slice("w", s + 1, span))) == 0)
    near = postings(idx).join(known, "word").where(F.array_contains(around, F.col("word2")) & whole)
    return near.select("doc_id", "th", "pos", "id").distinct().join(_sized(holders, max_broadcast), "id").select("doc_id", "th", "pos", "items")


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    idx = index(docs)
    windows, holders = item_windows(items, n)
    found = occurrences(idx, windows, max_broadcast)
    by_doc = checkpointed(found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.collect_set("id").alias("ids")))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).cast("long").alias("n"),
    )
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step)["n"]
    named = by_doc.select("doc_id", "th", F.explode("ids").alias("id")).join(_sized(holders, max_broadcast), "id").select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.explode("items").alias("item"))
    named = named.groupBy("d", "h").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = by_doc.select("doc_id", "th", hit.alias("hit")).join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "hit", "items")
    out = idx.select("doc_id", "th", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the rows that hold any window, of items with or without an item_id."""
    d, h = free_name(docs, "__d"), free_name(docs, "__h")
    windows, _ = item_windows(items, n, unnamed=True)
    bad = occurrences(index(docs), windows, max_broadcast).select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct()
    return docs.join(bounded(bad), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM bs),
ln AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ln WHERE len(w) >= n),
h AS (SELECT ds.doc_id, ds.s, ds.n, bw.item_id FROM ds JOIN bw ON bw.n = ds.n AND array_to_string(list_slice(ds.w, ds.s, ds.s + ds.n - 1), ' ') = bw.win),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
