import hashlib
import random

from pyspark.sql import functions as F

from quillsift.llm import line_dedup as D
from tests.llm.helpers import WORD, corpus, empty, frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits(a, b, per, most):
    return min(max(min(len(a), len(b)) // per, 1), most)


def is_near(a, b, per=D.PER, most=D.MOST):
    k = edits(a, b, per, most)
    if abs(len(a) - len(b)) > k:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    a, b = a[p:], b[p:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return distance(a, b) <= k


def brute(rows, per=D.PER, most=D.MOST):
    first = {}
    lines = [(d, i, x) for d, t, _ in rows for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    for d, i, x in sorted(lines):
        first.setdefault(x, (d, i))
    long = [x for x in first if len(x) >= D.MIN_CHARS]
    near = {x for x in long if any(first[y] < first[x] and is_near(y, x, per, most) for y in long if y != x)}
    out = []
    for d, t, _ in rows:
        parts = (t or "").split("\n")
        gone = [bool(WORD.search(x)) and (first[x] != (d, i) or x in near) for i, x in enumerate(parts)]
        kept = "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
        out.append((d, sum(bool(WORD.search(x)) for x in parts), sum(gone), hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out)


def variants(seed, n=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((20, 24, 25, 48, 49, 70, 131)))) + "z" for _ in range(5)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(4):
            x = list(rng.choice(bases))
            for _ in range(rng.choice((0, 1, 1, 2))):
                at, how = rng.randrange(len(x)), rng.randrange(3)
                if how == 0:
                    x[at] = rng.choice("abcXY")
                elif how == 1:
                    x.insert(at, rng.choice("abcXYé😀"))
                else:
                    del x[at]
            lines.append("".join(x))
        rows.append((d, "\n".join(lines + ["", "short"]), "a"))
    return rows


def check(spark, rows):
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_md5) for r in D.query(frame(spark, rows)).collect())
    assert got == brute(rows)


def removed(spark, rows, per, most):
    return {r.doc_id: r._removed for r in D.dedup(frame(spark, rows), per, most).collect()}


def test_edits_against_brute_force(spark):
    check(spark, variants(1))


def test_corpus_against_brute_force(spark):
    check(spark, corpus())


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    while len(pairs) < 600:
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(11))) for _ in range(2))
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(2)
    chars = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    for most in (1, 2, 3, 5):
        for r in df.select("a", "b", D.banded_distance(chars("a"), chars("b"), most).alias("d")).collect():
            want = distance(r.a, r.b)
            assert (r.d <= most) == (want <= most) and (want > most or r.d == want), (r.a, r.b)


def test_segment_keys_meet(spark):
    rng = random.Random(8)
    pairs = []
    for per, most in ((10, 1), (10, 2), (10, 3), (8, 4)):
        for _ in range(150):
            x = [rng.choice("abc") for _ in range(rng.randrange(20, 60))]
            y = list(x)
            for _ in range(rng.randrange(1, most + 1)):
                at, how = rng.randrange(len(y)), rng.randrange(3)
                y[at : at + (how != 1)] = rng.choice("abc") if how < 2 else ""
            x, y = "".join(x), "".join(y)
            if min(len(x), len(y)) >= D.MIN_CHARS and is_near(x, y, per, most):
                pairs.append((per, most, x, y))
    for per, most in {p[:2] for p in pairs}:
        df = spark.createDataFrame([p[2:] for p in pairs if p[:2] == (per, most)], "x string, y string")
        keys = lambda c: D.segment_keys(F.col(c), F.length(c), per, most)  # noqa: E731, B023
        assert df.filter(~F.arrays_overlap(keys("x"), keys("y"))).count() == 0


def test_a_pair_of_very_long_lines(spark):
    line = "".join(random.Random(4).choices("abcdefgh ", k=1_000_000))
    near = line[:500_000] + "XY" + line[500_001:]
    far = line[:1000] + "QQQQQQ" + line[1000:]
    got = D.query(frame(spark, [(1, line, "a"), (2, near, "a"), (3, far, "a")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 0}


def test_null_ids_come_first(spark):
    line = "a line that is long enough to be near to others"
    got = D.query(frame(spark, [(1, line, "a"), (None, line + "!", "a"), (2, line, "a")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: 1, 2: 1}


def test_identical_rows_empty_table_and_columns(spark):
    rows = [(1, "a line that is long enough\n\nb", "a")] * 3
    got = sorted(r.n_removed for r in D.query(frame(spark, rows)).collect())
    assert got == [0, 2, 2]
    assert D.query(empty(spark)).count() == 0
    docs = frame(spark, [*corpus(), *rows]).withColumn("_k", F.lit(1)).withColumn("gone", F.lit("x"))
    out = D.dedup_documents(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert {4, 5, 6} <= {r.doc_id for r in kept} and all(r.text is None or r.n_chars == len(r.text) for r in kept)


def far_variants(seed, per):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefghijkl ") for _ in range(n)) for n in (2 * per - 1, 2 * per, 3 * per + 1, 3 * per + 7, 4 * per + 2, 7 * per)]
    rows = []
    for d in range(60):
        x = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            at, how = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (how != 1)] = rng.choice(["X", "é", "😀", "b"]) if how < 2 else ""
        rows.append((d, "".join(x) + "\n" + "shared start of many lines, long enough to key " + "".join(rng.choice("mnop") for _ in range(60)), "a"))
    return rows


def test_thresholds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 8)  # so that groups have several blocks
    before = None
    for per, most in ((40, 1), (40, 2), (40, 3), (25, 4)):
        rows = far_variants(most, 40)
        want = {d: n for d, _, n, _ in brute(rows, per, most)}
        assert removed(spark, rows, per, most) == want
        assert before is None or sum(want.values()) > 0
        before = want
