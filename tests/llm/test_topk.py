import random

from pyspark.sql import functions as F

from quillsift.llm import topk as T


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and abs(x) != float("inf") and x == x for x in v):
            good.setdefault(i, set()).add(tuple(int((256 * x) // 1) for x in v))
    out = []
    for q in sorted(i for i in good if i % 50 == 0):
        best = {}
        for a in good[q]:
            for i, vs in good.items():
                for b in vs:
                    if i != q:
                        s = sum(x * y for x, y in zip(a, b, strict=False))
                        best[i] = max(s, best.get(i, s))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1)]
    return out


def check(spark, rows):
    df = vectors(spark, rows)
    single = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in T.query(df).collect())
    assert got == brute(single)


def test_random_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    monkeypatch.setattr(T, "QUERIES", 3)
    rng = random.Random(1)
    check(spark, [(i, [rng.gauss(0, 0.4) for _ in range(16)]) for i in range(600)])


def test_ties_repeats_nulls_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(2)) for _ in range(6)]) for i in range(300)]
    rows += [(50, rows[50][1]), (60, rows[60][1]), (100, [1.0] * 6), (7, None), (8, [None] + [1.0] * 5), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (11, [1.0, 2.0]), (12, []), (400, [0.0] * 6)]
    check(spark, rows)


def test_large_values_stay_exact(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.choice((-1, 1)) * rng.random() * 2**14 for _ in range(8)]) for i in range(200)])


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])])
    assert T.query(vectors(spark, [])).count() == 0
    assert T.query(vectors(spark, [(0, [1.0])])).count() == 0
    more = vectors(spark, [(0, [1.0]), (1, [2.0])]).withColumn("g", F.lit(5)).withColumn("rank", F.lit("x"))
    assert T.query(more).count() == 1


def test_reading_stops_early():
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.integers(-100, 100, (2000, 8))
    lists = T.Lists(np.arange(2000), data)
    q = rng.integers(-100, 100, (5, 8))
    got = lists.top(np.full(5, -1), q, np.full(5, -np.inf), 5)
    for j in range(5):
        s = data @ q[j]
        want = sorted(zip((-s).tolist(), range(2000), strict=True))[:5]
        assert [(-a, i) for a, i in want] == got[j]


def test_repeated_ids_in_different_blocks_count_once(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    rng = random.Random(5)
    check(spark, [(i % 60, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(240)])


def test_query_blocks_are_not_broadcast(spark):
    rng = random.Random(9)
    df = vectors(spark, [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)])
    plan = T.query(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
