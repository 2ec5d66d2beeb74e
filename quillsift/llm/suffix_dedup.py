"""Suffix-array dedup: bytes covered by a string of WIDTH bytes that also starts elsewhere are removed.

Only suffixes' first WIDTH bytes matter, so the sort is a radix sort of limited depth: each pass splits the groups of the
last one by more of their bytes, drops what is alone, and stops for suffixes whose whole window is known to repeat.

Pass 0 takes as first digit a string of KEY bytes inside the window: the one with the least hash among the window's KEY-byte
strings (the leftmost of equals). It depends on the window's bytes alone, so equal windows agree on it and on its place.
Neighbouring windows share it; such a run is one row. A run whose key is alone is unique and gone. A run whose whole hull
(all bytes of its windows) occurs again with the same layout is repeated and done.
Pass 1 cuts the runs that are left into cells of CELL neighbouring windows. A cell's core (the bytes that all its windows
share) is the next digit, its hull decides as before.
Pass 2 looks at the single windows of the remaining cells by all their WIDTH bytes: groups of two or more are exactly the
repeated windows.
A pass groups by 64-bit hashes, of which every row carries two that must both agree (key and hull, core or window). Counts
are pre-aggregated, and only (key, count) rows are joined back, so that a passage that most documents share stays spread out.

Units. The same passes run over two kinds of units: over bytes, WIDTH of them a window, for what is removed; and over words,
WORDS of them a window, for `n_shared_words`: the words that lie in a window of that many words (lower-cased A-Z) which another
document has too, wherever lines break. That finds passages of WORDS words or more that are shorter than WIDTH bytes.

Defined results: null texts are empty; repeated rows count as two documents for bytes, so their windows repeat, and as one
for words; an empty table gives an empty result. A text of any length is read in overlapping parts of bounded size; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.bytehash import U64, Hashes, flat, mix, slices, sliding_min, word_hashes, words_of
from quillsift.llm.common import arrow_batches, row_key, stage, staged

WIDTH, KEY, CELL = 400, 64, 24
WORDS, WORD_KEY, WORD_CELL = 50, 6, 4
PART = 1 << 20

_RUNS = "k long, pos int, n int, x int, core long, hull long"
_MASK = U64((1 << 28) - 1)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def find_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key string: (text number, first window's start in data, windows, key's distance, two hashes)."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < width:
        return none
    h = Hashes(data)
    keys = h.every(key)
    ranked = (mix(keys) & ~_MASK) | np.arange(len(keys), dtype=U64)
    least = sliding_min(ranked, width - key + 1)
    fits = np.zeros(len(least), bool)
    for s, e in zip(starts, ends, strict=True):
        if e - s >= width:
            fits[s : e - width + 1] = True
    at = np.flatnonzero(fits)
    if not len(at):
        return none
    place = (least[at] & _MASK).astype(np.int64)
    edge = np.flatnonzero((place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))
    first, last = np.r_[0, edge + 1], np.r_[edge, len(at) - 1]
    a, b, p = at[first], at[last], place[first]
    n, x = b - a + 1, p - a
    hull = mix(h.of(a, b + width) + mix((x << 16 | n).astype(U64)))
    long = ends - starts >= width
    text = np.flatnonzero(long)[np.searchsorted(starts[long], a, "right") - 1]
    return text, a, n, x, mix(keys[p]), hull


def _units(column: pa.Array, words: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, units, offsets of the rows' texts in them) for slices of bounded size, or one long text."""
    data, offsets = flat(column)
    for lo, hi in slices(offsets):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if words and hi == lo + 1:
            own = words_of(own)
            at = np.array([0, len(own)])
        elif words:
            own, first, stop = word_hashes(own, at[:-1], at[1:])
            at = np.append(first, stop[-1])
        yield lo, hi, own, at


def _runs(docs: DataFrame, width: int, key: int, words: bool) -> DataFrame:
    """Rows of _RUNS for (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            got = []
            for lo, hi, own, at in _units(batch.column(1), words):
                for part in range(0, max(len(own) - width + 1, 1), PART) if hi == lo + 1 else [0]:
                    stop = min(part + PART + width - 1, len(own)) if hi == lo + 1 else len(own)
                    s, e = at[:-1] - part, at[1:] - part
                    text, a, n, x, core, hull = find_runs(own[part:stop], np.maximum(s, 0), np.minimum(e, stop - part), width, key)
                    got.append((ids[lo + text], (a - s[text]).astype(np.int32), n.astype(np.int32), x.astype(np.int32), _i64(core), _i64(hull)))
            cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.empty(0, t) for t in ("i8", "i4", "i4", "i4", "i8", "i8")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "pos", "n", "x", "core", "hull"])

    return docs.select("k", "text").mapInArrow(run, _RUNS)


def _split(rows: DataFrame, name: str, twice: Column) -> tuple[list[DataFrame], DataFrame]:
    """One pass over rows with core and hull: (those repeated as a whole, those to split further). twice tells a repeated group."""
    cores = rows.groupBy("core").agg(twice.alias("_t"), F.min("hull").alias("_lo"), F.max("hull").alias("_hi")).filter("_t")
    # counts are staged: a join whose both sides are shuffled for it lets Spark split a hot key's rows
    cores = stage(cores.select("core", (F.col("_lo") == F.col("_hi")).alias("_one")), f"suffix-{name}-cores")
    alive = stage(rows.join(cores, "core"), f"suffix-{name}")
    mixed = alive.filter(~F.col("_one")).drop("_one")
    hulls = mixed.groupBy("core", "hull").agg(twice.alias("_t"), F.min(F.struct("k", "pos")).alias("_w")).filter("_t")
    hulls = stage(hulls, f"suffix-{name}-hulls")
    decided = stage(mixed.join(hulls, ["core", "hull"], "left"), f"suffix-{name}-rest")
    # one of each repeated hull goes on as a witness: others may share some of its windows
    rest = decided.filter(F.col("_t").isNull() | (F.struct("k", "pos") == F.col("_w"))).drop("_t", "_w")
    return [alive.filter("_one").drop("_one"), decided.filter("_t IS NOT NULL").drop("_t", "_w")], rest


def _contexts(docs: DataFrame, runs: DataFrame, width: int, words: bool) -> DataFrame:
    """The units of each run's hull beside it."""
    wanted = runs.groupBy("k").agg(F.collect_list(F.struct("pos", "n", "x", "core")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            keys, wanted_ = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, hi, own, at in _units(b.column(1), words):
                for i in range(lo, hi):
                    text = own[at[i - lo] : at[i - lo + 1]]
                    out += [(keys[i], r["pos"], r["n"], r["x"], r["core"], text[r["pos"] : r["pos"] + r["n"] - 1 + width].tobytes()) for r in wanted_[i]]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "pos", "n", "x", "core", "bytes"])

    return docs.join(wanted, "k").select("k", "text", "runs").mapInArrow(run, "k long, pos int, n int, x int, core long, bytes binary")


def _joined(column: pa.Array, words: bool) -> tuple[Hashes, np.ndarray]:
    """Hashes over the units of all values of a binary column, and where each value starts."""
    raw = column.to_pylist()
    units = np.frombuffer(b"".join(raw), U64 if words else np.uint8)
    return Hashes(units), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64) // units.itemsize


def _cells(contexts: DataFrame, width: int, cell: int, words: bool) -> DataFrame:
    """Pass 1's rows: cells of windows on a fixed grid of the key's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, pos, n, x, core = (np.asarray(b.column(i)) for i in range(5))
            h, starts = _joined(b.column(5), words)
            pos, n, x = (v.astype(np.int64) for v in (pos, n, x))
            lo, hi = (x - n + 1) // cell, x // cell
            many = hi - lo + 1
            row = np.repeat(np.arange(len(k)), many)
            c = np.arange(len(row)) - np.repeat(many.cumsum() - many, many) + lo[row]
            x1, x2 = np.maximum(c * cell, (x - n + 1)[row]), np.minimum(c * cell + cell - 1, x[row])
            key = starts[row] + x[row]  # the key string's place in the buffer
            mark = core[row].view(U64)
            whole = mix(h.of(key - x2, key - x1 + width) + mix((x1 << 16 | x2).astype(U64)))
            shared = mix(mix(h.of(key - c * cell, key - (c * cell + cell - 1) + width)) + mark * U64(3) + mix(c.astype(U64)))
            out = [k[row], (pos[row] + x[row] - x2).astype(np.int32), (x2 - x1 + 1).astype(np.int32), x2.astype(np.int32), _i64(shared), _i64(whole), pos[row].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["k", "pos", "n", "x", "core", "hull", "run"])

    return contexts.select("k", "pos", "n", "x", "core", "bytes").mapInArrow(run, _RUNS + ", run int")


def _windows(contexts: DataFrame, cells: DataFrame, width: int, words: bool) -> DataFrame:
    """Pass 2's rows: single windows of the cells that are left."""
    wanted = cells.groupBy("k", "run").agg(F.collect_list(F.struct("pos", "n", "core")).alias("cells")).withColumnRenamed("run", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, starts = _joined(b.column(2), words)
            k, pos = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for i, cells_ in enumerate(b.column(3).to_pylist()):
                out += [(k[i], starts[i] + c["pos"] - pos[i], c["pos"], c["n"], c["core"]) for c in cells_]
            key, at, where, n, core = (np.array(v, np.int64) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(n.cumsum() - n, n)
            window = mix(h.of(at[row] + step, at[row] + step + width))
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array((where[row] + step).astype(np.int32)), pa.array(core[row]), pa.array(_i64(window))], names=["k", "pos", "core", "window"])

    return contexts.join(wanted, ["k", "pos"]).select("k", "pos", "bytes", "cells").mapInArrow(run, "k long, pos int, core long, window long")


def repeated(docs: DataFrame, width: int = WIDTH, key: int = KEY, cell: int = CELL, words: bool = False) -> DataFrame:
    """(k, pos, n) for docs (k, text): n windows from unit pos on of the text k occur elsewhere too.

    Units are bytes, and elsewhere is any other place; or units are words, and elsewhere is another text k.
    """
    twice = F.min("k") < F.max("k") if words else F.count("*") > 1
    runs = stage(_runs(docs, width, key, words), "suffix-runs")
    done, left = _split(runs, "0", twice)
    contexts = stage(_contexts(docs, left, width, words), "suffix-contexts")
    cells = stage(_cells(contexts, width, cell, words), "suffix-cells")
    more, rest = _split(cells, "1", twice)
    windows = stage(_windows(contexts, rest, width, words), "suffix-windows")
    again = stage(windows.groupBy("core", "window").agg(twice.alias("_t")).filter("_t").select("core", "window"), "suffix-twice")
    single = windows.join(again, ["core", "window"]).select("k", "pos", F.lit(1).alias("n"))
    out = single
    for part in [*done, *more]:
        out = out.unionByName(part.select("k", "pos", "n"))
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long"


def _marks(docs: DataFrame, name: str, **how) -> DataFrame:
    """(k, name): the runs of repeated windows of each text k that has any."""
    make = lambda: repeated(docs, **how).groupBy("k").agg(F.collect_list(F.struct("pos", "n")).alias(name))
    return staged(docs.sparkSession, f"suffix-{name}", make)


def _covered(found: pa.Scalar, width: int) -> list[list[int]]:
    """[start, end] of the maximal stretches that the marked windows cover, rising."""
    out: list[list[int]] = []
    for m in sorted(found.as_py() or [], key=lambda m: m["pos"]):
        end = m["pos"] + m["n"] - 1 + width
        if out and m["pos"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([m["pos"], end])
    return out


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False, words: int = WORDS) -> DataFrame:
    """Per document of (doc_id, text) the row of _RESULT; with_text adds the kept bytes and the removed spans."""
    arrow_batches(docs.sparkSession)
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), "text")
    texts = keyed.select("k", "text")
    shared = _marks(texts, "shared", width=words, key=min(WORD_KEY, words), cell=WORD_CELL, words=True)
    marks = _marks(texts, "marks", width=width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            rows = []
            for i, found in enumerate(b.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                spans = _covered(found, width)
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2], strict=True))
                lent = sum(e - s for s, e in _covered(b.column(3)[i], words))
                row = [len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), lent]
                rows.append(row + ([kept, ",".join(f"{s}:{e}" for s, e in spans)] if with_text else []))
            cols = list(zip(*rows, strict=True)) or [[]] * (7 if with_text else 5)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept", "spans"][: len(cols) + 1]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]], names=names)

    return keyed.join(marks, "k", "left").join(shared, "k", "left").select("doc_id", "text", "marks", "shared").mapInArrow(run, _RESULT + (", kept binary, spans string" if with_text else ""))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return dedup(docs.select("doc_id", "text"))
