import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillsift.llm import suffix_dedup as D
from quillsift.llm.bytehash import Hashes, sliding_min, words_of
from tests.llm.helpers import WORD, corpus, empty, frame, prose


def brute(rows, width):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[p : p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, width=400, key=64):
    want = brute(rows, width)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.dedup(frame(spark, rows), width).collect())
    assert got == sorted((i, *w) for (i, _, _), w in zip(rows, want, strict=True))


def test_against_brute_force(spark):
    check(spark, corpus())


def test_edits_overlaps_and_repeated_rows(spark):
    base = prose(300, 9)
    cut = [base[:900] + "!" + base[900:], base[5:1200] + prose(50, 1), prose(40, 2) + base[300:705] + prose(40, 3), base[300:699], "é" + base[100:900], base]
    rows = [(i, t, "a") for i, t in enumerate(cut)] + [(7, "ab" * 700, "a"), (8, "same row " * 60, "a"), (8, "same row " * 60, "a"), (None, prose(100, 4), "a")]
    want = brute(rows, 400)
    got = sorted(str(tuple(r)[:5]) for r in D.query(frame(spark, rows)).collect())
    assert got == sorted(str((i, *w)) for (i, _, _), w in zip(rows, want, strict=True))


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 700)
    data = prose(3000, 11).encode()
    text = np.frombuffer(data, np.uint8)
    whole = D.find_runs(text, np.array([0]), np.array([len(text)]))
    assert whole[2].sum() == len(text) - 400 + 1


def test_helpers():
    x = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    assert (sliding_min(x, 37) == np.array([x[i : i + 37].min() for i in range(464)])).all()
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = Hashes(data).every(3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_empty_table_and_extra_columns(spark):
    assert D.query(empty(spark)).count() == 0
    assert D.query(frame(spark, corpus()).withColumn("k", F.lit(1))).count() == len(corpus())
    out = D.dedup(frame(spark, [(1, prose(200, 1), "a"), (2, prose(200, 1), "a")]), with_text=True).collect()
    assert all(bytes(r.kept) == b"" and r.spans == f"0:{r.n_bytes}" for r in out)


def brute_words(rows, width=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {(d, t): WORD.findall((t or "").translate(lower)) for d, t, _ in rows}
    holders = {}
    for key, w in texts.items():
        for p in range(len(w) - width + 1):
            holders.setdefault(tuple(w[p : p + width]), set()).add(key)
    out = []
    for d, t, _ in rows:
        w = texts[d, t]
        held = set()
        for p in range(len(w) - width + 1):
            if len(holders[tuple(w[p : p + width])]) > 1:
                held |= set(range(p, p + width))
        out.append((str(d), len(held)))
    return sorted(out)


def test_shared_words_against_brute_force(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    broken = passage.upper().replace(" ", "\n", 20).replace(" ", " \t ", 5)
    rows = [*corpus(), (70, prose(30, 40) + " " + passage + " " + prose(30, 41), "a"), (71, prose(80, 42) + "\n" + broken + "\n" + prose(9, 43), "b")]
    rows += [(72, " ".join(passage.split()[:50]), "a"), (73, " ".join(passage.split()[:49]), "a"), (74, ("again " * 30 + "\n") * 9, "a"), (75, (prose(52, 44) + " ") * 3, "a")]
    rows += [(76, passage, "a"), (76, passage, "a"), (None, passage + " é", "a")]
    got = sorted((str(r.doc_id), r.n_shared_words) for r in D.query(frame(spark, rows)).collect())
    want = brute_words(rows)
    assert got == want
    assert dict(want)["73"] == dict(want)["74"] == dict(want)["75"] == 0 and dict(want)["70"] == dict(want)["71"] == 55


def test_words_of_long_texts_in_parts():
    data = np.frombuffer((prose(500, 3) + " " + "x" * 300 + "\n" + prose(20, 4) + " ").encode(), np.uint8)
    whole = words_of(data)
    assert len(whole) == 521 and all((words_of(data, part) == whole).all() for part in (7, 64, 1000))
