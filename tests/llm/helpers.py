"""Fixtures and plain-Python forms of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus():
    """(doc_id, text, source): nulls, empty and blank texts, copies, near copies, a shared passage, repeated lines, one long text."""
    base, passage = prose(120, 1), prose(90, 2)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, "a"), (5, "", None), (6, " \t\n ", "b"),
        (7, prose(40, 3) + "\n" + passage + "\n" + prose(30, 4), "c"), (8, prose(50, 5) + "\n" + passage, "a"),
        (9, "one two three", "c"), (10, "One TWO three", "c"), (11, "same line here, long enough to count\n" * 5 + "tail", "a"),
        (12, prose(20_000, 6, 5000), "d"), (13, "é ü 漢字 😀 " * 30, "d"), (14, passage, "b"), (15, "x" * 3000, "a"), (16, "ab " * 900, "a"),
    ]
    rows += [(20 + i, prose(60, 100 + i), "a" if i % 3 else "b") for i in range(12)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
