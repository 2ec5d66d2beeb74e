import corpus_pipeline
from pyspark.sql import functions as F

from quillsift.llm import quality_rules
from tests.llm.helpers import DOCS
from tests.llm.test_jaccard import brute as components
from tests.llm.test_line_dedup import brute as lines

WORDS = "the river and a stone in that old house was by some tree of many people who went to town for bread".split()


def documents(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(80):
        text = "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(30)) * (rng.random() < 0.7) for _ in range(25)) for _ in range(3))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1] + " tail", "en", "s1", 1), (102, "###", "en", "s0", 3), (103, None, "en", None, 0), (104, "same again " * 40, "en", "s2", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages_against_plain_python(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["quality_rules"](spark, docs, "")
    assert kept.columns == names
    verdicts = {r.doc_id: r.kept for r in quality_rules.query(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    assert set(range(80)) <= {r.doc_id for r in kept.collect()} and not {102, 103, 104} & {r.doc_id for r in kept.collect()}

    deduped = steps["line_dedup"](spark, kept, "")
    assert deduped.columns == names
    held = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    left = {d: n for d, n, gone, _ in lines(held) if n == 0 or gone < n}
    assert {r.doc_id for r in deduped.collect()} == set(left)

    one = steps["ngram_jaccard"](spark, deduped, "")
    held = [(r.doc_id, r.text, r.source) for r in deduped.collect()]
    assert one.columns == names
    assert {r.doc_id for r in one.collect()} == {d for d, n, c in components(held) if n == 0 or d == c}

    mixed = steps["mixing"](spark, one, "")
    assert mixed.columns == names
    texts = {r.doc_id: r.text for r in one.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect()) and mixed.count() > 0

    packed = steps["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    assert len(rows) > 80


def test_run_and_names(spark, tmp_path):
    documents(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < sizes <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mixing", "packing"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
