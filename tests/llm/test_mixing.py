import heapq
import random

from pyspark.sql import functions as F

from quillsift.llm import mixing as M
from tests.llm.helpers import WORD, corpus, empty, frame, prose


def water(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def check(spark, rows, tail=0.0, **how):
    got = M.mix(frame(spark, rows), **how).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * M.BLOCK_WORDS + tail * t, (s, taken[s], t)
    return got


def test_targets_and_shares(spark):
    check(spark, corpus())


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(i, prose(100, i), "big") for i in range(30)] + [(100, prose(40, 9), "mid"), (101, prose(20, 8), "tiny"), (102, prose(7, 7), None)]
    got = check(spark, rows)
    assert {r.source for r in got if r.target == 3 * r.source_size} >= {"tiny"}


def test_many_shards_and_reruns_agree(spark):
    rows = [(i, prose(50, i), f"s{i % 4 if i % 3 else 0}") for i in range(200)]
    a = check(spark, rows, shard_words=700)
    b = check(spark, rows, shard_words=700)
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in b)


def heap_seats(votes, n):
    """Seats by the highest quotients, one at a time; ties go to the smaller number."""
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(n if heap else 0):
        _, i, k = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-(votes[i] / (2 * k + 3)), i, k + 1))
    return out


def test_apportionment_equals_a_heap(spark):
    rng = random.Random(6)
    groups = [([53.0, 24.0, 23.0, 1.0], 7), ([10_000.0] + [0.51] * 1000, 10_510), ([1.0] * 40, 13), ([0.0, 0.0], 5), ([0.0, 5.0, 5.0, 5.0, 1e-9], 4), ([3.0], 9), ([2.0, 1.0], 0)]
    groups += [([rng.paretovariate(0.6) for _ in range(300)], n) for n in (1, 17, 299, 5000)]
    groups += [([float(rng.randrange(4)) for _ in range(200)], n) for n in (3, 150, 1001)]
    rows = [(g, i, v, n) for g, (votes, n) in enumerate(groups) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v double, n long").repartition(3)
    got = {(r.g, r.i): r.seats for r in M.apportion(df, "g", "v", "n", "seats", "i").collect()}
    for g, (votes, n) in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == heap_seats(votes, n), g


def test_numbers_of_sources(spark):
    names = [None, "", "b", "a", "é", "😀", "Z", "\uffff"]
    df = spark.createDataFrame([(x, 1) for x in names], "source string, source_size long")
    got = [r.source for r in M.numbered(df).orderBy("_i").collect()]
    assert got == sorted(names, key=lambda x: (x is None, (x or "").encode()))


def test_long_tail_of_sources(spark):
    rows = [(i, prose(300, i), "big") for i in range(20)] + [(100 + i, prose(1 + i % 3, i), f"s{i}") for i in range(150)]
    check(spark, rows, tail=0.01, shard_words=500)  # seats in whole blocks: rounded tails take from the large source or give to it



def test_documents_are_whole_and_columns_stay(spark):
    docs = frame(spark, corpus()).withColumn("size", F.lit("own")).withColumn("_k", F.lit(1))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {t for _, t, _ in corpus()}
    rows = out.collect()
    assert rows and all(r.text in texts and r["size"] == "own" for r in rows)
    assert M.mix(empty(spark)).count() == 0


def test_identical_rows_share_what_is_taken(spark):
    rows = [(1, prose(300, 1), "a")] * 3 + [(2, prose(300, 2), "b")]
    check(spark, rows)
    n = M.mixed_documents(frame(spark, rows)).filter("doc_id = 1").count()
    assert n <= 9
