"""Line dedup: lines that many documents share stay in the smallest doc_id only.

Normalised lines are exploded with their positions and hashed to 128 bits, once; that table, of a few bytes a line, is kept. Distinct documents
are counted per hash, with partial aggregation; lines whose hash is over the threshold go back to their documents as bits by position; and each
text is reassembled from the positions that are left. Texts are shuffled once, for that last step, and never sorted, as they stream past the
bits; lines themselves are never shuffled. A very frequent line is a hot key of short rows, which adaptive execution splits.

Defined cases: a null or empty text is one empty line (a null text stays null); a row without doc_id passes unchanged and its lines count nowhere;
rows that share a doc_id count as one document and each loses its lines; an empty table gives no rows; other columns pass through, whatever
their names, but for n_lines and n_dropped where counts are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, apart, ascii_lower, free_name, stored, table

_BITS = 64


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, pos, h1, h2): each line's place and key, without lines too short to count; th is a hash of the text, which tells rows of one doc_id apart."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", ascii_lower(F.trim(F.col("line"), F.lit(SPACE))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h1, h2, keeper): keys found in min_docs documents or more, and the document that keeps them."""
    g = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n_docs"))
    return g.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def lines_to_drop(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(doc_id, th, drop): for each document that loses lines, their positions as bits, 64 to a word."""
    lost = (
        lines.select("doc_id", "th", "pos", *apart("h1", "h2"))
        .join(shared_lines(lines, min_docs).select("keeper", *apart("h1", "h2")), ["__k0", "__k1"])
        .where(F.col("doc_id") > F.col("keeper"))
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % _BITS)
    lost = lost.select("doc_id", "th", F.floor(F.col("pos") / _BITS).cast("int").alias("w"), bit.alias("bit")).repartition("doc_id", "th")
    words = lost.groupBy("doc_id", "th", "w").agg(F.bit_or("bit").alias("bits"))
    of = words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return of.select("doc_id", "th", dense.alias("drop"))


def _stays(drop: Column, pos: Column) -> Column:
    word = F.coalesce(F.get(drop, F.floor(pos / _BITS).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftright", word, pos % _BITS).bitwiseAND(F.lit(1).cast("long")) == 0


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, counts: bool = True) -> DataFrame:
    """docs with text without its dropped lines and, if asked for, n_lines and n_dropped in place of columns of these names."""
    id_, th, lost = (free_name(docs, x) for x in ("__doc", "__th", "__drop"))
    lines = stored(line_keys(docs, min_chars))
    drop = lines_to_drop(lines, min_docs).select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("drop").alias(lost))
    out = docs.join(drop.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(th)), "left").drop(id_, th)
    stay = F.filter(F.split("text", "\n", -1), lambda line, pos: _stays(F.col(lost), pos))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    more = {}
    if counts:
        n_dropped = F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)), F.lit(0).cast("long"))
        n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
        more = {"n_lines": n_lines.cast("long"), "n_dropped": n_dropped}
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in more]
    return out.select(*cols, *[v.alias(k) for k, v in more.items()])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, counts=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id > s.keeper) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
