"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids, and longer ones than a sequence are cut. Pieces that fill a sequence are done; the others are dealt by
hash into blocks of bounded size. Each block is bred on several islands, from best-fit-decreasing solutions of its pieces in
slightly shuffled orders: crossover injects whole well-filled bins of one parent into another, bins that hold an injected piece are
taken apart (so that no piece is twice there), and what is displaced is put back by best fit; fewer bins win, and then the fuller ones.
Each island then sends its elite to the next one, which breeds on from both, as often as there are migrations; the best island of a block
wins. Breeding stops early only when the bins are as few as their tokens allow, which no search can better; it is short while a further round
follows, as open bins are packed again there. Bins that stay short of full are opened again, and their pieces of all blocks are
dealt anew, round after round, until one block holds them all. Where a round closes under a tenth of its pieces (their sizes hardly
fill a sequence), only the least-filled eighth of each block's open bins, one at least, is opened again and the others are done: few pieces
are left soon, and the badly filled bins of all blocks meet in one.

Ids: a word's ids don't depend on its neighbours, as the tokenizer splits at white space first; a worker remembers words up to a
fixed number. Texts with the separators U+001C to U+001F, on which notions of white space differ, are encoded whole.

Defined cases: a null or empty text is one piece of one token (the closing 0); repeated rows are packed each; a null doc_id stays
null and is packed; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MEMO_MAX, Memo, checkpointed, give_back, map_arrow, table

CAP, BLOCK, ISLANDS, MIGRATIONS, FULL = 2048, 4096, 2, 2, 0.998
SHORT, LONG = {"population": 4, "generations": 6}, {"population": 10, "generations": 120}
#: White space that is no ASCII white space, and the separators on which notions of white space differ.
_ODD = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_APART = re.compile("[\x1c-\x1f]")
#: A word that is letters, then ASCII signs: the tokenizer splits it there.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-/:-@\[-`{-~]*)$"


class Encoder:
    """Ids of whole texts, exactly those of the tokenizer.

    Arrow tells the words of a batch apart and cuts them into letters and signs, so that Python sees each such part once a batch; a part's ids lie
    in one flat array, from which numpy gathers those of whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.parts = {kind: Memo() for kind in ("letters", "signs", "other")}
        self.at = {kind: np.zeros(0, "i4") for kind in self.parts}  # the rows of their words
        self.first, self.size, self.flat = np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0, "<u4")

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the place where each text's ids begin (and where the last ones end)."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        whole: dict[int, np.ndarray] = {}
        if len(odd):
            plain = texts.to_pylist()
            for k in odd.tolist():
                if _APART.search(plain[k]):
                    whole[k], plain[k] = np.array(self._whole([plain[k]])[0], "<u4"), ""
                else:
                    plain[k] = " ".join(plain[k].split())
            texts = pa.array(plain, pa.string())
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if len(self.size) > MEMO_MAX:
            self._forget()
        cut = pc.extract_regex(coded.dictionary, _SIMPLE)
        simple = cut.is_valid()
        letters, signs = self._rows(pc.utf8_lower(pc.struct_field(cut, "letters").filter(simple)), "letters"), self._rows(pc.struct_field(cut, "signs").filter(simple), "signs")
        other = self._rows(coded.dictionary.filter(pc.invert(simple)), "other")
        rows = np.full((len(coded.dictionary), 2), self._rows(pa.array([""]), "other")[0], "i4")  # no ids
        at = simple.to_numpy(zero_copy_only=False)
        rows[at, 0], rows[at, 1], rows[~at, 0] = letters, signs, other
        rows = rows[coded.indices.to_numpy()].ravel()
        size = self.size[rows]
        upto = np.zeros(len(rows) + 1, "i8" if len(rows) > 1 << 24 else "i4")
        np.cumsum(size, out=upto[1:])
        at = np.repeat(self.first[rows] - upto[:-1], size)
        at += np.arange(len(at), dtype=at.dtype)
        ids = self.flat[at]
        cuts = upto[2 * (ends - ends[0])]
        if whole:
            parts = [whole.get(k, ids[cuts[k] : cuts[k + 1]]) for k in range(len(texts))]
            ids, cuts = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        return ids, cuts

    def _rows(self, parts: pa.Array, kind: str) -> np.ndarray:
        """The rows of parts, which are learned if they are new."""
        coded = parts.dictionary_encode()
        number, new = self.parts[kind].numbers(coded.dictionary)
        if new:
            ids, size = self._letters(new) if kind == "letters" else self._each(new)
            self.at[kind] = np.concatenate([self.at[kind], np.arange(len(self.size), len(self.size) + len(new), dtype="i4")])
            self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(size) - size).astype("i4")])
            self.size = np.concatenate([self.size, size.astype("i4")])
            self.flat = np.concatenate([self.flat, ids])
        return self.at[kind][number][coded.indices.to_numpy()]

    def _letters(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In one call: each run of letters ends with the one token that ends a word."""
        ids = np.array(self._whole([" ".join(new)])[0], "<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(new) and cut[-1] == len(ids):
            return ids, np.diff(np.r_[0, cut])
        return self._each(new)

    def _each(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self._whole(new)
        return np.array([i for x in got for i in x], "<u4"), np.fromiter(map(len, got), "i8", len(got))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, path: str, cap: int = CAP, with_ids: bool = False, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids as little-endian unsigned 32-bit binary."""

    def fn(b: pa.RecordBatch) -> dict:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        at, piece, start, length, crc, ids = [], [], [], [], [], []
        end = np.array([end_id], "<u4").tobytes()
        tokens, cuts = enc.encode(b.column("text"))
        raw = memoryview(tokens).cast("B")
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            n = hi - lo + 1
            for p, s in enumerate(range(0, n, cap)):
                e = min(n, s + cap)
                part = bytes(raw[4 * (lo + s) : 4 * (lo + min(e, n - 1))]) + (end if e == n else b"")
                at.append(i)
                piece.append(p)
                start.append(s)
                length.append(e - s)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        out = {"doc_id": b.column("doc_id").take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": crc}
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), fn, schema)


def best_fit(sizes: list[int], order: Iterable[int], cap: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts each item of order into the bin that it fills best, or a new one."""
    bins = [list(b) for b in bins or []]
    at: dict[int, list[int]] = {}
    mask = 0
    for k, b in enumerate(bins):
        room = cap - sum(sizes[i] for i in b)
        at.setdefault(room, []).append(k)
        mask |= 1 << room
    for i in order:
        s = sizes[i]
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            own = at[room]
            k = own.pop()
            if not own:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            room, k = cap, len(bins)
            bins.append([i])
        room -= s
        own = at.setdefault(room, [])
        own.append(k)
        mask |= 1 << room
    return bins


def _loads(bins: list[list[int]], sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


def _fitness(bins: list[list[int]], sizes: list[int], cap: int) -> tuple[int, float]:
    """Less is better."""
    return len(bins), -sum((x / cap) ** 2 for x in _loads(bins, sizes))


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], cap: int, rng: np.random.Generator) -> list[list[int]]:
    """b's well-filled bins, a share of them, injected into a."""
    load = np.array(_loads(b, sizes))
    full = np.flatnonzero(load >= min(0.99 * cap, np.quantile(load, 0.5)))
    take = [b[k] for k in rng.permutation(full)[: max(1, len(full) // 3)]]
    inside = {i for x in take for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced.extend(i for i in x if i not in inside)
    weak = np.argsort(_loads(kept, sizes), kind="stable")[: max(1, len(kept) // 20)].tolist()  # mutation: the emptiest are opened, and one by chance
    gone = {*weak, int(rng.integers(len(kept)))} if kept else set()
    for k in gone:
        displaced.extend(kept[k])
    kept = [list(x) for k, x in enumerate(kept) if k not in gone]
    displaced = _fuller(kept, displaced, sizes, cap)
    return best_fit(sizes, sorted(displaced, key=lambda i: (-sizes[i], i)), cap, take + kept)


def _fuller(bins: list[list[int]], displaced: list[int], sizes: list[int], cap: int) -> list[int]:
    """Swaps in place: a displaced piece for a shorter one, or two, of a bin that it fills better; what is displaced then is shorter and fits more easily."""
    free = sorted((sizes[i], i) for i in displaced)
    for b in bins:
        room = cap - sum([sizes[i] for i in b])
        if not room or not free:
            continue
        best, pick = 0, None
        for out in [(i,) for i in b] + (list(combinations(b, 2)) if len(b) <= 6 else []):
            own = sum([sizes[i] for i in out])
            k = bisect_right(free, (own + room, 1 << 62)) - 1
            if k >= 0 and free[k][0] - own > best:
                best, pick = free[k][0] - own, (k, out)
        if pick:
            b.append(free.pop(pick[0])[1])
            for i in pick[1]:
                b.remove(i)
                insort(free, (sizes[i], i))
    return [i for _, i in free]


def decreasing(sizes: list[int], cap: int) -> list[list[int]]:
    """Best fit of the pieces from the longest on."""
    return best_fit(sizes, np.argsort(-np.array(sizes), kind="stable").tolist(), cap)


def evolve(sizes: list[int], cap: int, seed: int, start: list[list[list[int]]] | None = None, population: int = 10, generations: int = 120) -> list[list[int]]:
    """The best solution that an island finds, from the given ones or from best fit; it ends early only with as few bins as the tokens allow."""
    if not sizes:
        return []
    rng, least = np.random.default_rng(seed), -(-sum(sizes) // cap)
    big = np.array(sizes, "f8")
    pool = list(start or [decreasing(sizes, cap)])
    while len(pool) < population and min(map(len, pool)) > least:
        pool.append(best_fit(sizes, np.argsort(-big * rng.uniform(0.9, 1.1, len(big)), kind="stable").tolist(), cap))
    score = [_fitness(x, sizes, cap) for x in pool]
    for _ in range(generations):
        best = min(score)
        if best[0] <= least or len(pool) < 2:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        if score[j] < score[i]:
            i, j = j, i
        child = crossover(pool[j], pool[i], sizes, cap, rng)
        worst = max(range(len(pool)), key=lambda k: score[k])
        own = _fitness(child, sizes, cap)
        if own < score[worst] and own not in score:
            pool[worst], score[worst] = child, own
    return pool[min(range(len(pool)), key=lambda k: score[k])]


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ORDER = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]]


def _labels(bins: list[list[int]], n: int) -> pa.Array:
    out = np.empty(n, "i4")
    for k, b in enumerate(bins):
        out[b] = k
    return pa.array(out)


def _seed(*x: int) -> int:
    return zlib.crc32(repr(x).encode())


def _round(open_items: DataFrame, n_blocks: int, salt: int, cap: int, islands: int, migrations: int, effort: dict[str, int]) -> DataFrame:
    """Open pieces with block, bin, offset, load, by the block's best island."""
    names = [x.split()[0] for x in _ITEM.split(", ")]
    # rand() draws alike again if a task is repeated: its rows are a checkpoint's, in fixed partitions
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.rand(salt) if n_blocks > 1 else F.lit(salt)), F.lit(n_blocks))
    dealt = open_items.select(key.cast("int").alias("block"), *names)
    dealt = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), *names)
    schema = f"block int, island int, source int, {_ITEM}, bin int"

    def sent(block: int, island: int, t: pa.Table, bins: list[list[int]], to: set[int]) -> pa.Table:
        """The island's solution, for each island that it goes to."""
        n = t.num_rows
        t = t.append_column("bin", _labels(bins, n))
        each = [t.add_column(0, "source", pa.array([island] * n, pa.int32())).add_column(0, "island", pa.array([k] * n, pa.int32())) for k in sorted(to)]
        return pa.concat_tables(each).add_column(0, "block", pa.array([block] * n * len(each), pa.int32()))

    def first(key, t):
        block, island = (x.as_py() for x in key)
        t = t.select(names).sort_by(_ORDER)
        sizes = t["length"].to_pylist()
        bins = decreasing(sizes, cap)
        if len(bins) * cap - sum(sizes) < cap:  # as few as the tokens allow: nothing to breed, and one island is enough
            return sent(block, island, t if island == 0 else t.slice(0, 0), bins if island == 0 else [], {island})
        bins = evolve(sizes, cap, _seed(salt, block, island), [bins], **effort)
        return sent(block, island, t, bins, {island, (island + 1) % islands})

    def onward(leg: int):
        def run(key, t):
            block, island = (x.as_py() for x in key)
            sources = sorted(set(t["source"].to_pylist()))
            parts = [t.filter(pc.equal(t["source"], s)).sort_by(_ORDER) for s in sources]
            start = []
            for p in parts:  # each source holds the same pieces in the same order
                bins: dict[int, list[int]] = {}
                for i, k in enumerate(p["bin"].to_pylist()):
                    bins.setdefault(k, []).append(i)
                start.append(list(bins.values()))
            own = parts[0].select(names)
            best = evolve(own["length"].to_pylist(), cap, _seed(salt, block, island, leg), start, **effort) if len(start) > 1 else start[0]
            return sent(block, island, own, best, {island, (island + 1) % islands} if leg < migrations and len(start) > 1 else {island})

        return run

    def choose(t):
        give_back()
        one = [t.filter(pc.equal(t["island"], k)) for k in sorted(set(t["island"].to_pylist()))]
        score = [(len(s := np.bincount(x["bin"].to_numpy(), x["length"].to_numpy())), -float((s * s).sum())) for x in one]
        t = one[score.index(min(score))].sort_by([(c, "ascending") for c in ("bin", "doc_id", "piece", "start")])
        b, size = t["bin"].to_numpy(), t["length"].to_numpy()
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        total = np.cumsum(size) - size
        load = np.add.reduceat(size, head)
        n = np.diff(np.r_[head, len(b)])
        return t.select(["block", *names, "bin"]).append_column("offset", pa.array(total - np.repeat(total[head], n))).append_column("load", pa.array(np.repeat(load, n)))

    out = dealt.groupBy("block", "island").applyInArrow(first, schema)
    for leg in range(1, migrations + 1):
        out = out.groupBy("block", "island").applyInArrow(onward(leg), schema)
    return out.groupBy("block").applyInArrow(choose, f"block int, {_ITEM}, bin int, offset long, load long")


def pack(pieces: DataFrame, cap: int = CAP, block: int = BLOCK, islands: int = ISLANDS, migrations: int = MIGRATIONS, full: float = FULL) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = checkpointed(pieces)
    names = pieces.columns
    whole = pieces.where(F.col("length") >= cap).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, salt = [whole], pieces.where(F.col("length") < cap), 0
    while True:
        n = rest.count()
        if not n:
            break
        n_blocks = -(-n // block)
        salt += 1
        # bins that stay open are dealt anew, so that a short search is enough while there is a further round
        got = checkpointed(_round(rest, n_blocks, salt, cap, islands, *((1, SHORT) if n_blocks > 1 else (migrations, LONG))))
        seq = (-F.lit(1).cast("long") - F.lit(salt << 56) - F.call_function("shiftleft", F.col("block").cast("long"), F.lit(24)) - F.col("bin")).alias("sequence_id")
        if n_blocks == 1:
            done.append(got.select(*names, seq, "offset"))
            break
        closed = F.col("load") >= full * cap
        left = got.where(~closed).count()
        if left > 0.9 * n or salt > 40:  # hardly any bin came full: dealing them all anew gains nothing, and most bins stay as they are
            got = checkpointed(_round(rest, n_blocks, salt, cap, islands, migrations, LONG))
            bins = got.where(~closed).select("block", "bin", "load").distinct()
            worst = F.row_number().over(Window.partitionBy("block").orderBy("load", "bin")) <= F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("block")) / 8))
            worst = bins.select(F.col("block").alias("__b"), F.col("bin").alias("__n"), worst.alias("__open"))
            got = checkpointed(got.join(worst, (F.col("block") == F.col("__b")) & (F.col("bin") == F.col("__n")), "left"))
            closed = ~F.coalesce("__open", F.lit(False))
            left = got.where(~closed).count()
            if left == n:  # a bin a block: larger blocks
                block *= 2
        done.append(got.where(closed).select(*names, seq, "offset"))
        rest = got.where(~closed).select(*names)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, cap: int = CAP) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(docs, path, cap), cap)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
