import random

from pyspark.sql import functions as F

from quillsift.llm import jaccard as J
from quillsift.llm.components import components
from tests.llm.helpers import corpus, empty, frame, prose


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(rows))


def check(spark, rows, **how):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join(frame(spark, rows), **how).collect())
    assert got == brute(rows)


def variants(n, seed, length=80, edits=3):
    rng = random.Random(seed)
    base = prose(length, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rows = [*corpus(), (70, "A B c", "a"), (71, "a b C", "a"), (72, prose(120, 1).upper(), "a")]
    check(spark, rows)


def test_groups_larger_than_a_block(spark):
    texts = variants(150, 1) + variants(60, 2, edits=9) + [prose(60, 3) + " " + prose(50, 100 + i) for i in range(80)] + [prose(50, 3)] * 40
    check(spark, [(i, t, "a") for i, t in enumerate(texts)], block=16)


def test_tree_finds_all_that_pairs_find():
    import numpy as np
    import pyarrow as pa

    texts = variants(90, 5, edits=12) + variants(40, 6, length=30, edits=2)
    sets = list(J._sets(pa.array(texts), 4))
    members = [J.Member(i, len(s), J.bitmap(s), s) for i, s in enumerate(sets)]
    union = J.Union()
    J.tree_links(members, union, J.do_link)
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                assert union.find(i) == union.find(j)
                assert J.may_link(members[i], members[j])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_empty_and_clashing(spark):
    docs = frame(spark, corpus()).withColumn("_k", F.lit(1)).withColumn("component_id", F.lit("x"))
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect())
    assert 2 not in ids and 3 not in ids and {1, 4, 5, 6, 9} <= set(ids) and 10 not in ids
    assert J.query(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0
    twice = frame(spark, [(1, prose(50, 1), "a")] * 3)
    assert J.keep_one(twice).count() == 1 and J.query(twice).count() == 3


def stage_ids(rows):
    """doc_ids that stay by five words and 0.8, from plain sets."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], d), d)
    return sorted(d for i, (d, _, _) in enumerate(rows) if not sets[i] or least[label[i]] == d)


def test_stage_takes_five_words_and_four_fifths(spark):
    base = prose(100, 60).split()
    between = [*base[:50], "other", *base[51:]]
    between[80:82] = ["two", "more"]
    texts = [" ".join(base), " ".join(between), *variants(60, 61, edits=6), *variants(40, 62, length=60, edits=4)]
    rows = [*corpus(), *((200 + i, t, "a") for i, t in enumerate(texts))]
    want = stage_ids(rows)
    assert want != sorted(d for d, n, c in brute(rows) if n == 0 or d == c)
    assert sorted(r.doc_id for r in J.keep_one(frame(spark, rows)).collect()) == want


def test_keep_one_by_component_where_doc_ids_repeat(spark):
    a, b, c = prose(50, 71), prose(50, 72), prose(50, 73)
    rows = [(1, a, "a"), (1, b, "a"), (2, a + " tail", "a"), (3, b, "a"), (None, c, "a"), (None, c, "a"), (None, "", "a"), (None, "", "a")]
    got = sorted((r.doc_id or 0, r.text) for r in J.keep_one(frame(spark, rows)).collect())
    assert got == sorted([(1, a), (1, b), (0, c), (0, ""), (0, "")])


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    from quillsift.llm import components as C

    plans = []

    def seen(df, name, real=J.stage):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(J, "stage", seen)
    monkeypatch.setattr(C, "stage", seen)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[: 40 - i % 3])) for i in range(6)] + [(9, "alone here")]
    out = J.query(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, 0) for i in range(6)} | {(9, 9)}
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    # whole texts alone may meet a table that is small by its rows, not by its files
    assert [name for name, plan in plans if "Broadcast" in plan and name != "jaccard-sets"] == []


def test_copies_are_no_members_of_groups_and_blocks_are_few(spark, monkeypatch):
    tables = {}

    def seen(df, name, real=J.stage):
        tables[name] = real(df, name)
        return tables[name]

    monkeypatch.setattr(J, "stage", seen)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[: 40 - i % 3])) for i in range(300)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.query(docs).collect()} == {(i, 0) for i in range(300)}
    assert tables["jaccard-ties"].agg({"blocks": "max"}).first()[0] == 1
    # 30 texts that share a few rare words and link in pairs
    docs = spark.createDataFrame([(i, " ".join(words[:5] + [f"x{i // 2}y{j}" for j in range(60)] + [f"z{i}"])) for i in range(60)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in J.join(docs, block=1).collect()}
    assert got == {(i, i - i % 2) for i in range(60)}
    assert tables["jaccard-ties"].agg({"blocks": "max"}).first()[0] <= J.SPREAD
