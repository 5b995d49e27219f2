"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary, of whole texts.

The tokenizer is a unigram one without a pre-tokenizer: a text gets a word mark in front, spaces become word marks, and the whole, with its line ends
and runs of spaces, is segmented into the pieces of highest total score. An Aho-Corasick automaton enumerates the pieces that end at each place,
longest first; dynamic programming carries only the best score and the number of pieces to each place. The rules are those of the public unigram
tokenizers: scores add up from the left, a later candidate must be strictly better (so ties go to the longest last piece), a character that no
one-character piece covers may be unknown at the lowest score less 10, and an unknown character counts as its UTF-8 bytes (byte fallback).
Pieces and scores are read from a public SentencePiece file, whose path is a parameter; nothing is trained. (The file at hand holds a BPE vocabulary, whose
scores are ranks: they are taken as scores of a unigram tokenizer, so that counts are those of this one and not of the file's own merges.)

No piece holds a mark behind another character, so that no piece crosses the place before a run of marks, and the best segmentation is that of
the stretches between these places; line ends, which no piece holds, part stretches too. Arrow cuts and tells apart the stretches of a batch; each is
counted once a worker and remembered up to a fixed number of stretches. A vocabulary for which this doesn't hold is refused. Scores must be whole
numbers or such that sums are exact for ties to be those of the whole text's sums.

Defined cases: a null or empty text has 0 words and 0 tokens; a mark in a text is a space; a stretch without spaces or line ends of any length is one,
in time and memory proportional to it; repeated rows count alike; a null doc_id stays null; an empty table gives no rows; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_MAX, Memo, map_arrow, table

MARK, PENALTY = "▁", 10.0
_WORD = r"[^\x20\x09-\x0D]+"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a SentencePiece file, and their scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in pieces):
            raise ValueError("a piece crosses the places at which texts are cut")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self._forget()

    def _forget(self) -> None:
        self.memo, self.counts = Memo(), np.zeros(0, "i4")

    def pieces(self, text: str) -> int:
        """Pieces of the best segmentation of text, taken as it is."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        single = [False] * n  # whether a one-character piece covers it
        at = 0

        def settle(e: int) -> None:
            """The unknown candidate of the place that ends at e comes after all others, as its start is the last."""
            if not single[e - 1]:
                s = best[e - 1] + self.unknown
                if best[e] is None or s > best[e]:
                    best[e], count[e] = s, count[e - 1] + len(text[e - 1].encode())

        for last, (size, score) in self.automaton.iter(text):
            e = last + 1
            while at < last:  # places that no piece ends at
                at += 1
                settle(at)
            s = best[e - size] + score
            if best[e] is None or s > best[e]:
                best[e], count[e] = s, count[e - size] + 1
            if size == 1:
                single[last] = True
        while at < n:
            at += 1
            settle(at)
        return count[n]

    def texts(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Tokens of each whole text."""
        t = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        full = pc.if_else(pc.equal(pc.binary_length(t), 0), "", pc.binary_join_element_wise(MARK, pc.replace_substring(t, " ", MARK), ""))
        cut = pc.split_pattern(pc.replace_substring_regex(full, f"({MARK}+)", "\n\\1"), "\n")
        ends = cut.offsets.to_numpy()
        coded = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if len(self.memo) > MEMO_MAX:
            self._forget()
        number, new = self.memo.numbers(coded.dictionary)
        if new:
            self.counts = np.concatenate([self.counts, np.fromiter(map(self.pieces, new), "i4", len(new))])
        count = self.counts[number][coded.indices.to_numpy()]
        upto = np.r_[0, np.cumsum(count)][ends - ends[0]]
        return np.diff(upto) + pc.count_substring(t, "\n").to_numpy()  # a line end is unknown, and one byte


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each whole text."""

    def fn(b: pa.RecordBatch) -> dict:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(vocabulary(path))
        t = b.column("text")
        n_words = pc.fill_null(pc.count_substring_regex(t, _WORD), 0).cast(pa.int64())
        return {"doc_id": b.column("doc_id"), "n_words": n_words, "n_tokens": _COUNTERS[path].texts(t)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
