import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillsift.operators import corpus as C
from quillsift.operators import metrics as M


def by_permutations(truth, found):
    n = min(len(truth), len(found))
    score = lambda pairs: round(sum(M._overlap(truth[i], found[j]) for i, j in pairs), 9)
    options = [list(zip(rows, cols, strict=True)) for rows in itertools.combinations(range(len(truth)), n) for cols in itertools.permutations(range(len(found)), n)]
    return max(options, key=score, default=[])


def test_best_matching_against_all_permutations():
    rng = random.Random(3)
    for _ in range(400):
        spans = lambda n: sorted((s, s + rng.randrange(0, 9)) for s in (rng.randrange(20) for _ in range(n)))
        truth, found = spans(rng.randrange(6)), spans(rng.randrange(6))
        assert [(i, j) for i, j, _ in M.best_matching(truth, found)] == by_permutations(truth, found), (truth, found)


def test_best_matching_of_many_spans():
    truth = [(10 * i, 10 * i + 6) for i in range(40)]
    found = [(10 * i + 1, 10 * i + 6) for i in reversed(range(40))]
    assert [(i, j) for i, j, _ in M.best_matching(truth, found)] == [(i, 39 - i) for i in range(40)]


def test_checked_pick_raises_on_overlap_and_repeats(spark):
    picked = spark.range(4).withColumnRenamed("id", "k")
    assert C.checked_pick(picked, "k", picked.filter("k > 9")).count() == 4
    with pytest.raises(Exception, match="held already: 2"):
        C.checked_pick(picked, "k", picked.filter("k = 2")).collect()
    with pytest.raises(Exception, match="picked twice: 1"):
        C.checked_pick(picked.unionByName(picked.filter("k = 1")), "k").collect()


def test_review_sample_is_balanced_and_repeatable(spark):
    pool = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") % 5 == 0, "bad").otherwise("good").alias("label"), (F.col("id") % 3).alias("verdict"))
    draw = lambda: C.review_sample(pool, "k", "label", "verdict", {"good": 12, "bad": 12}, 7, pool.filter("k < 50"))
    a, b = ({r.k: (r.label, r.verdict) for r in draw().collect()} for _ in range(2))
    assert a == b and len(a) == 24 and min(a) >= 50
    assert sorted(x for x in a.values()) == sorted([(label, v) for label in ("good", "bad") for v in (0, 1, 2) for _ in range(4)])
