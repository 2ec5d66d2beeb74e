"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into blocks of BLOCK bytes; two neighbouring blocks make a chunk, so chunks overlap by half and cover
the whole text. Learned filters of WIDTH bytes slide over a fixed encoding of the bytes; a chunk keeps each filter's
highest and lowest answer (max-pooling of both signs), a dense layer makes hidden values of them, and their highest and
mean values over all chunks give one probability. Fitting uses at most MAX_TRAINING labelled rows of MAX_BYTES bytes in all,
each a whole text, of which every round draws CHUNKS chunks anew; scoring reads every byte, in slices of bounded size within
a text too.

Defined results: null and empty texts are one block of padding; NUL bytes count as padding; without labels of both kinds the
score is their share; a doc_id that documents repeat is learnt from once, by its least text, and each of its rows is scored; an
empty table gives an empty result; extra columns, also such with clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_batches, held_out, stage
from quillsift.llm.labelled import training_rows

MAX_TRAINING, MAX_BYTES = 6_000, 96 << 20
WIDTH, STRIDE, BLOCK = 8, 4, 256
FILTERS, HIDDEN = 24, 16
ROUNDS, BATCH, CHUNKS = 12, 128, 4
SEED = 11
PER_BLOCK = BLOCK // STRIDE
#: Bytes scored at once; a longer text is scored alone.
SLICE = 1 << 19


def encoding(seed: int = SEED) -> np.ndarray:
    """256 rows: classes of bytes and a few random values that tell bytes of a class apart; byte 0 (padding) is zero."""
    b = np.arange(256)
    low, up = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    space, line, digit, high = b == 32, b == 10, (b >= 48) & (b <= 57), b >= 128
    classes = np.stack([low, up, space, line, digit, high, ~(low | up | space | line | digit | high)], 1)
    out = np.concatenate([classes, np.random.default_rng(seed).normal(0, 0.6, (256, 5))], 1).astype(np.float32)
    out[0] = 0
    return out


def padded(raw: bytes) -> np.ndarray:
    """Bytes in whole blocks, with padding after them: the last window must not read on into another text."""
    n = -(-(len(raw) + WIDTH - STRIDE) // BLOCK)
    out = np.zeros(n * BLOCK, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


class Network:
    """Weights, forward pass and fitting by Adam."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.code = encoding()
        d = WIDTH * self.code.shape[1]
        f32 = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.w = {"f": f32(d, FILTERS, scale=d**-0.5), "fb": np.zeros(FILTERS, np.float32), "h": f32(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), "hb": np.zeros(HIDDEN, np.float32), "o": f32(2 * HIDDEN, scale=0.2), "ob": np.zeros(1, np.float32)}

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Rows of WIDTH encoded bytes, one per STRIDE; past the end there is padding."""
        x = self.code[np.concatenate([data, np.zeros(WIDTH - STRIDE, np.uint8)])]
        n, d = len(data) // STRIDE, self.code.shape[1]
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * d), (STRIDE * d * 4, 4)).copy()

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(blocks, 2 * FILTERS): highest answers and negated lowest ones of each block; padding windows don't count."""
        if len(data) > SLICE:
            # blocks are pooled alone; a window reads on into the bytes after its block
            parts = [np.concatenate([data[at : at + SLICE], data[at + SLICE : at + SLICE + BLOCK]]) for at in range(0, len(data), SLICE)]
            return np.concatenate([self._pooled(x)[: SLICE // BLOCK] for x in parts])
        return self._pooled(data)

    def _pooled(self, data: np.ndarray) -> np.ndarray:
        a = np.tanh(self.windows(data) @ self.w["f"] + self.w["fb"]).reshape(-1, PER_BLOCK, FILTERS)
        off = (data[::STRIDE] == 0).reshape(-1, PER_BLOCK)
        off[:, 0] = False
        if off.any():
            return np.concatenate([np.where(off[..., None], -2, a).max(1), np.where(off[..., None], -2, -a).max(1)], 1)
        return np.concatenate([a.max(1), -a.min(1)], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; texts are scored in slices of bounded size."""
        out = np.empty(len(texts))
        some: list[int] = []
        size = 0

        def flush() -> None:
            if not some:
                return
            data = [padded(texts[i]) for i in some]
            n = np.array([len(x) // BLOCK for x in data])
            pools = self.pooled(np.concatenate(data))
            ends = n.cumsum()
            last = np.zeros(len(pools), bool)
            last[ends - 1] = True
            after = np.where(last[:, None], pools, np.roll(pools, -1, 0))
            lone = (last & (np.repeat(n, n) > 1))  # the last block of a longer text is in the chunk before it already
            hidden = np.maximum(np.maximum(pools, after) @ self.w["h"] + self.w["hb"], 0)
            hidden[lone] = 0  # values are 0 or more, so this changes no maximum
            starts = ends - n
            top = np.maximum.reduceat(hidden, starts, 0)
            mean = np.add.reduceat(hidden, starts, 0) / np.maximum(n - 1, 1)[:, None]
            z = np.concatenate([top, mean], 1) @ self.w["o"] + self.w["ob"][0]
            out[some] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            some.clear()

        for i, t in enumerate(texts):
            if size + len(t) > SLICE:
                flush()
                size = 0
            some.append(i)
            size += len(t)
        flush()
        return out

    def fit(self, texts: list[bytes], y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network:
        """Minimise log loss; each round sees CHUNKS random chunks of every text."""
        rng = np.random.default_rng(seed)
        data = [padded(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for r in range(rounds):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                chunks = np.zeros((len(pick), CHUNKS, 2 * BLOCK), np.uint8)
                for i, k in enumerate(pick):
                    n = len(data[k]) // BLOCK
                    for j, s in enumerate(rng.integers(0, max(n - 1, 1), CHUNKS)):
                        piece = data[k][s * BLOCK : (s + 2) * BLOCK]
                        chunks[i, j, : len(piece)] = piece
                g = self.gradient(chunks, y[pick])
                step += 1
                rate = 0.006 * (1 - r / rounds) + 0.0005
                for k in self.w:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def gradient(self, chunks: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of a batch of texts, each given as some chunks."""
        w, (b, c, size) = self.w, chunks.shape
        per = size // STRIDE
        x = np.concatenate([self.windows(row) for row in chunks.reshape(b * c, size)]).reshape(b * c, per, -1)
        a = np.tanh(x @ w["f"] + w["fb"])
        off = (chunks.reshape(b * c, size)[:, ::STRIDE] == 0)
        off[:, 0] = False
        hi, lo = np.where(off[..., None], -2, a).argmax(1), np.where(off[..., None], -2, -a).argmax(1)
        rows, cols = np.arange(b * c)[:, None], np.arange(FILTERS)[None]
        pool = np.concatenate([a[rows, hi, cols], -a[rows, lo, cols]], 1)
        pre = pool @ w["h"] + w["hb"]
        hid = np.maximum(pre, 0).reshape(b, c, HIDDEN)
        best = hid.argmax(1)
        z = np.concatenate([hid.max(1), hid.mean(1)], 1)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"][0], -30, 30)))
        dz = ((p - y) / b).astype(np.float32)
        g = {"o": z.T @ dz + 1e-4 * w["o"], "ob": np.array([dz.sum()], np.float32)}
        dh = np.zeros_like(hid) + (dz[:, None] * w["o"][HIDDEN:])[:, None] / c
        np.add.at(dh, (np.arange(b)[:, None], best, np.arange(HIDDEN)[None]), dz[:, None] * w["o"][:HIDDEN])
        dh = dh.reshape(b * c, HIDDEN) * (pre > 0)
        g["h"], g["hb"] = pool.T @ dh + 1e-4 * w["h"], dh.sum(0)
        dp = (dh @ w["h"].T) * (1 - pool**2)
        up, down = dp[:, :FILTERS], -dp[:, FILTERS:]
        g["f"] = np.einsum("ifd,if->df", x[rows, hi], up) + np.einsum("ifd,if->df", x[rows, lo], down) + 1e-4 * w["f"]
        g["fb"] = up.sum(0) + down.sum(0)
        return g


class Model:
    """A fitted network, or a constant where there was nothing to learn."""

    def __init__(self, network: Network | None, share: float):
        self.network, self.share = network, share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.network.score(texts) if self.network else np.full(len(texts), self.share)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, size: int = MAX_BYTES) -> Model:
    """A model of labels.quality."""
    some = training_rows(docs, labels, "quality", most).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    some = stage(some, "cnn-rows")
    sizes = some.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id", F.lit(SEED)).alias("h")).toPandas().sort_values(["h", "doc_id"])
    fits = sizes[sizes.n.cumsum() <= size].doc_id.tolist()  # bounded like the rows
    got = some.join(F.broadcast(some.sparkSession.createDataFrame([(int(i),) for i in fits], "doc_id long")), "doc_id").select("doc_id", "text", "label").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))  # rows come in any order
    y = np.array([r[2] for r in rows], float)
    if len(np.unique(y)) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.0)
    return Model(Network().fit([r[1].encode("utf-8", "replace") for r in rows], y), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
