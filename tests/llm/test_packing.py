import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillsift.llm import packing as P
from tests.llm.helpers import corpus, empty, frame, prose

ROWS = [*corpus(), (60, "text <|endoftext|> more", "a"), (61, "  spaces\t\n\n and 漢字 😀 it's 123", "a"), (61, "  spaces\t\n\n and 漢字 😀 it's 123", "a")]


def test_round_trip_and_no_overlap(spark):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = P.query(frame(spark, ROWS)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t, _ in ROWS:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))
        parts = parts[::2] if i == 61 else parts
        assert [r.start for r in parts] == [s for s, _ in P.cuts(len(ids))]
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert len(parts) == 1 or all(r.length == 1024 for r in parts[1:])
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by_seq) <= 1.1 * total / 1024 + 2


def test_genetic_search_keeps_items_and_never_loses():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1024) for _ in range(400)]
    start = P.best_fit_decreasing(sizes, list(range(400)), [], 1024)
    best = P.decoded(P.evolve(sizes, [], 1024, random.Random(2)))
    assert sorted(i for b in best for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in best)
    assert len(best) <= len(start)
    child = P.crossover(start, best, sizes, 1024, rng)
    assert sorted(i for b in child for i in b) == list(range(400))


def test_cuts():
    assert P.cuts(1024) == [(0, 1024)] and P.cuts(1) == [(0, 1)]
    assert P.cuts(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_small_shards_empty_table_and_ids(spark):
    docs = frame(spark, [(i, prose(i % 90 + 1, i), "a") for i in range(60)]).withColumn("uid", F.lit(1)).withColumn("length", F.lit("x"))
    out = P.pack(docs, shard=16, with_ids=True)
    rows = out.collect()
    assert len(rows) == 60 and all(len(r.ids) == 4 * r.length for r in rows)
    assert P.query(empty(spark)).count() == 0


def test_shards_together_come_near_the_bound(spark):
    rng = random.Random(7)
    sizes = [min(int(rng.lognormvariate(5.2, 0.9)) + 1, 1023) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, n int").withColumn("bin", F.lit(None).cast("long"))
    alone = -(-sum(sizes) // 1024)
    one = len(P.best_fit_decreasing(sizes, list(range(3000)), [], 1024))
    for shard in (150, 700):
        rows = P.packed_items(items, shard=shard).collect()
        assert sorted(r.u for r in rows) == list(range(3000))
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append(r)
        for held in bins.values():
            at = 0
            for r in sorted(held, key=lambda r: r.offset):
                assert r.offset == at
                at += sizes[r.u]
            assert at <= 1024
        if shard:
            assert alone <= len(bins) <= one + 1, (alone, len(bins), one)  # one: a single task over all items


def test_leftovers_are_not_made_worse():
    sizes = [600, 424, 500, 524, 300, 724]
    given = P.coded([[0, 1], [2, 3], [4, 5]], 6)
    assert len(P.decoded(P.evolve(sizes, [given], 1024, random.Random(1)))) == 3
