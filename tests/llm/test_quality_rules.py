from collections import Counter

from pyspark.sql import functions as F

from quillsift.llm import quality_rules as Q
from tests.llm.helpers import WORD, corpus, empty, frame


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts_match_plain_python(spark):
    rows = [*corpus(), (90, "a # b | c\n\nd", "a"), (91, "p q r s t " * 3, "a")]
    got = {r.doc_id: r for r in Q.query(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        want = counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


GOOD = "the cat sat on the mat and then it was late so they all went to bed in the old house by the sea"


def test_junk_goes_and_prose_stays(spark):
    good = GOOD
    rows = [(1, good, "a"), (2, " ".join(w + "###" for w in good.split()), "a"), (3, good.upper().replace(" ", "!! "), "a")]
    kept = {r.doc_id for r in Q.filter_documents(frame(spark, rows)).collect()}
    assert kept == {1}


def test_empty_table_extra_and_clashing_columns(spark):
    assert Q.query(empty(spark)).count() == 0
    extra = frame(spark, [*corpus(), (99, GOOD, "a")]).withColumn("_m", F.lit(1)).withColumn("_quality", F.lit("x")).withColumn("kept", F.lit(False))
    out = Q.filter_documents(extra)
    assert out.columns == extra.columns and out.count() > 0
    repeated = frame(spark, [(1, "t " * 5, "a")] * 3)
    assert Q.query(repeated).count() == 3
