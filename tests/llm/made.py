"""Small tables for the tests."""

import random

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more=()):
    """Documents from (doc_id, text); more: names of extra columns that clash with what operators use inside."""
    schema = SCHEMA + "".join(f", `{c}` string" for c in more)
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), *("x" for _ in more)) for i, t in rows], schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, ties and repeated rows, and a very long text."""
    long = " ".join(f"long{k % 977} {k % 13}" for k in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (None, None), (6, long), (7, "x" * 50_000), (8, "ÄÖ É ñ 日本語 \x1c \x85   é"), (9, "\n\n\n")]


def groups(nodes, linked):
    """Each node's least reachable node, by brute force."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
