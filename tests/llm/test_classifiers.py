import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import byte_cnn, toxicity
from quillsift.llm.labelled import training_rows
from tests.llm.helpers import corpus, empty, frame

LABELS = "doc_id long, quality int, toxic int"


def data(n=700, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(("la", "the", "tree", "house", "stone", "river", "blue", "walk")) + rng.choice("aeiou") for _ in range(rng.randrange(30, 120))]
        toxic, junk = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(("grumblefoo", "snarkwit", "grumbl3foo")))
            words.insert(3, "you")
        text = " ".join(w.upper() + "###" for w in words) if junk else " ".join(words) + "."
        docs.append((i, text, "a"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (byte_cnn, "quality", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    rows, labels = data()
    rows += [(9000 + i, t, s) for i, t, s in corpus()]
    got = {r.doc_id: r for r in module.query(frame(spark, rows).withColumn("score", F.lit("x")), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    known = {i: (q, t)[label == "toxic"] for i, q, t in labels}
    held = [r for r in got.values() if r.held_out and r.doc_id in known]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) >= least


@pytest.mark.parametrize("module", [toxicity, byte_cnn])
def test_no_labels_one_label_and_empty_tables(spark, module):
    docs = frame(spark, corpus())
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in module.query(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i, _, _ in corpus()], LABELS)
    assert {r.score for r in module.query(docs, one).collect()} == {1.0}
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1)], LABELS)
    assert module.query(empty(spark), odd).count() == 0


def test_training_never_sees_held_out_rows(spark):
    rows, labels = data(300)
    labels += [(0, 1, 1), (1, 1, 1)]
    got = training_rows(frame(spark, rows), spark.createDataFrame(labels, LABELS), "toxic", 10_000).collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == r.part != 0 for r in got)
    few = training_rows(frame(spark, rows), spark.createDataFrame(labels, LABELS), "toxic", 50).count()
    assert few < 120


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    a, p = toxicity.isotonic(raw, y)
    assert (np.diff(a) > 0).all() and (p >= 0).all() and (p <= 1).all()


def test_network_covers_the_whole_text():
    net = byte_cnn.Network()
    text = b"calm words here. " * 200
    changed = text[:-40] + b"#" * 40
    assert net.score([text])[0] != net.score([changed])[0]
    assert np.allclose(net.score([text, b"", changed]), [net.score([t])[0] for t in (text, b"", changed)])


def test_gradient_matches_differences():
    net = byte_cnn.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    chunks = rng.integers(65, 120, (3, 2, 2 * byte_cnn.BLOCK)).astype(np.uint8)
    y = np.array([0.0, 1.0, 1.0])

    def loss():
        out = 0.0
        for c, t in zip(chunks, y, strict=True):
            pools = np.stack([np.maximum(p[0], p[1]) for p in (net.pooled(x) for x in c)])
            hid = np.maximum(pools @ net.w["h"] + net.w["hb"], 0)
            p = 1 / (1 + np.exp(-(np.concatenate([hid.max(0), hid.mean(0)]) @ net.w["o"] + net.w["ob"][0])))
            out -= np.log(p if t else 1 - p) / len(y)
        return out

    g = net.gradient(chunks, y)
    for name, at in (("o", (3,)), ("h", (5, 2)), ("f", (10, 4)), ("fb", (1,))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-5
        up = loss()
        net.w[name][at] = old - 1e-5
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 2e-3


def by_loops(net, raw):
    """A text's score, filter by filter and window by window."""
    data = byte_cnn.padded(raw)
    ahead = np.concatenate([data, np.zeros(byte_cnn.WIDTH, np.uint8)])
    pools = []
    for at in range(0, len(data), byte_cnn.BLOCK):
        hi, lo = np.full(byte_cnn.FILTERS, -2.0), np.full(byte_cnn.FILTERS, -2.0)
        for p in range(at, at + byte_cnn.BLOCK, byte_cnn.STRIDE):
            if data[p] or p == at:
                a = np.tanh(net.code[ahead[p : p + byte_cnn.WIDTH]].reshape(-1) @ net.w["f"] + net.w["fb"])
                hi, lo = np.maximum(hi, a), np.maximum(lo, -a)
        pools.append(np.concatenate([hi, lo]))
    chunks = [np.maximum(p, q) for p, q in zip(pools, pools[1:], strict=False)] or pools
    hidden = np.maximum(np.array(chunks) @ net.w["h"] + net.w["hb"], 0)
    z = np.concatenate([hidden.max(0), hidden.mean(0)]) @ net.w["o"] + net.w["ob"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_loops_over_windows_also_in_slices(monkeypatch):
    rng = random.Random(5)
    net = byte_cnn.Network()
    texts = [b"", b"a", b"x" * 256, b"y" * 257, "é ü 漢字".encode(), bytes(rng.choices(b"abc XYZ.,\n123", k=5000)), bytes(rng.choices(b"abc ", k=1024))]
    want = [by_loops(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)
    monkeypatch.setattr(byte_cnn, "SLICE", 4 * byte_cnn.BLOCK)
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_fitting_reads_bounded_bytes(spark):
    rows, labels = data(200)
    docs, known = frame(spark, rows + rows[:50]), spark.createDataFrame(labels, LABELS)
    model = byte_cnn.fit(docs, known, size=20_000)
    assert 0 < model.share < 1 and model.network is not None
    assert byte_cnn.fit(docs, known, size=0).network is None
