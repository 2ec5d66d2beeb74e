"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

1. Texts become token ids (a public byte-level BPE vocabulary, then an end token). Only documents longer than a sequence
   are cut; the first piece takes what is over, the others are full. A row per piece is written to the shared folder.
2. Full pieces are sequences of their own. The others are dealt by hash into shards of about SHARD pieces. A shard has
   ISLANDS islands; each evolves a population of packings: crossover injects whole well-filled sequences of one parent
   into the other, removes the sequences that hold their pieces twice, and best-fits the displaced ones. After each
   epoch an island sends its elite to the next one of its shard, over a join of small rows.
3. Leftovers: each shard keeps its fullest sequences and hands on the emptiest quarter (HANDED), but for full ones. Those of all shards
   meet in new shards, whole, and are packed by the same search, which starts from them as they are; and so on, until one
   shard is left. So what shards waste is not one sequence each, but about one in all.
4. The best island's packing gives sequence_id and offset.

Defined results: a null or empty text is one piece, the end token alone; repeated rows are pieces of their own; an empty
table gives an empty result; extra columns, also such with clashing names, are ignored; a text of any length is encoded as a
whole, since its ids depend on it, and a repeated one once. A shard never ends worse than best-fit decreasing, nor than the
leftovers it was given.
"""

from __future__ import annotations

import base64
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_batches, stage

LIMIT = 1024
END = 2
SHARD = 4096
ISLANDS, EPOCHS, POPULATION = 2, 2, 4
#: Generations of an epoch: in the first round, and in those over leftovers, which are few.
GENERATIONS = (2, 12)
#: One in so many sequences of a shard is handed on, if it is not full.
HANDED = 4
MAX_TASKS = 20_000
SPECIAL = "<|endoftext|>"

_TOKENIZERS: dict = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = "byte_bpe_50k", pattern: str | None = None):
    """texts -> id arrays, as the `tokenizers` library gives them with `name`.json, without special tokens added.

    The same vocabulary as merge ranks (`name`.tiktoken) is several times faster and gives the same ids; texts with a
    special token's string, which the library turns into that token, go through the library itself.
    """
    if name not in _TOKENIZERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(vocabulary(f"{name}.json"))
        _TOKENIZERS[name] = (fast, full)
    fast, full = _TOKENIZERS[name]

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32)

    return encode


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, name: str = "byte_bpe_50k", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece of (doc_id, text); with_ids adds the ids as little-endian unsigned 32-bit integers."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        uid = TaskContext.get().partitionId() << 40
        known: dict[str, np.ndarray] = {}
        held = 0
        for b in batches:
            cols: list[list] = [[] for _ in range(6 + with_ids)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = known.get(text)
                if ids is None:  # copies that lie near each other are encoded once
                    ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                    held += len(text)
                    if held > 8_000_000:
                        known, held = {}, len(text)
                    known[text] = ids
                for k, (s, n) in enumerate(cuts(len(ids), limit)):
                    part = ids[s : s + n].tobytes()
                    row = (doc, k, s, n, zlib.crc32(part), uid, part)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    uid += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


# ---- the genetic algorithm; a packing is a list of bins, a bin a list of item numbers


class Shelf:
    """Open bins by free space; the least space that fits is the lowest set bit of a mask."""

    def __init__(self, limit: int):
        self.limit, self.mask = limit, 0
        self.by_space: list[list[list[int]]] = [[] for _ in range(limit + 1)]

    def put(self, bin_: list[int], free: int) -> None:
        self.by_space[free].append(bin_)
        self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        fit = self.mask >> size
        if not fit:
            self.put([item], self.limit - size)
            return
        free = size + ((fit & -fit).bit_length() - 1)
        spot = self.by_space[free]
        bin_ = spot.pop()
        if not spot:
            self.mask &= ~(1 << free)
        bin_.append(item)
        self.put(bin_, free - size)

    def bins(self) -> list[list[int]]:
        return [b for spot in self.by_space for b in spot]


def best_fit_decreasing(sizes: list[int], items: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """bins with items added, longest first."""
    shelf = Shelf(limit)
    for b in bins:
        shelf.put(list(b), limit - sum(sizes[i] for i in b))
    for i in sorted(items, key=lambda i: -sizes[i]):
        shelf.best_fit(i, sizes[i])
    return shelf.bins()


def fitness(sizes: list[int], bins: list[list[int]], limit: int) -> tuple[int, float]:
    """Fewer sequences, then fuller ones: greater is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / limit) ** 2 for b in bins)


def dominate(bins: list[list[int]], lost: list[int], sizes: list[int], limit: int) -> list[int]:
    """What is left of the lost items after bins took larger ones of them for smaller ones of their own, where these fit.

    One item goes for one or two lost ones, or two go for one: each exchange leaves a bin fuller and smaller items to place.
    """
    lost = sorted(lost, key=lambda i: sizes[i])
    spare = [sizes[i] for i in lost]

    def swap(b: list[int], out: tuple[int, ...], places: list[int]) -> None:
        taken = [lost[j] for j in places]
        for j in sorted(places, reverse=True):
            del lost[j], spare[j]
        for i in out:
            b.remove(i)
            j = bisect_right(spare, sizes[i])
            lost.insert(j, i)
            spare.insert(j, sizes[i])
        b += taken

    for b in bins:
        free = limit - sum(sizes[i] for i in b)
        if not free or not lost:
            continue
        best: tuple[int, tuple[int, ...], list[int]] = (0, (), [])
        outs = [(i,) for i in b] + [(i, j) for n, i in enumerate(b) for j in b[:n]] * (len(b) <= 6)
        for out in outs:
            held = sum(sizes[i] for i in out)
            j = bisect_right(spare, held + free) - 1
            if j >= 0 and spare[j] - held > best[0]:
                best = (spare[j] - held, out, [j])
            if len(out) == 1:
                lo, hi = 0, min(j, len(spare) - 1)
                while lo < hi:  # the largest pair that fits
                    pair = spare[lo] + spare[hi] - held
                    if pair > free:
                        hi -= 1
                    else:
                        if pair > best[0]:
                            best = (pair, out, [lo, hi])
                        lo += 1
            if best[0] == free:
                break
        if best[0]:
            swap(b, best[1], best[2])
    return lost


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], limit: int, rng: random.Random) -> list[list[int]]:
    """a with well-filled bins of b injected whole; bins of a that hold their items go, what they lose is best-fitted."""
    full = [x for x in b if sum(sizes[i] for i in x) >= 0.97 * limit]
    gift = rng.sample(full, k=max(1, len(full) // 3)) if full else []
    given = {i for x in gift for i in x}
    rest, lost = [], []
    for x in a:
        if given.isdisjoint(x):
            rest.append(x)
        else:
            lost += [i for i in x if i not in given]
    # some of the emptier bins are opened too: their items may close gaps elsewhere
    rest.sort(key=lambda x: sum(sizes[i] for i in x))
    emptier = rest[: max(2, len(rest) // 8)]
    chosen = set(rng.sample(range(len(emptier)), min(len(emptier), max(2, len(rest) // 50))))
    for k in chosen:
        lost += rest[k]
    rest = [list(x) for k, x in enumerate(rest) if k not in chosen]
    rng.shuffle(rest)
    lost = dominate(rest, lost, sizes, limit)
    return [*gift, *best_fit_decreasing(sizes, lost, rest, limit)]


def coded(bins: list[list[int]], n: int) -> bytes:
    """Bin number of each item."""
    out = np.zeros(n, np.uint32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def decoded(raw: bytes) -> list[list[int]]:
    at = np.frombuffer(raw, np.uint32)
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]


def evolve(sizes: list[int], seeds: list[bytes], limit: int, rng: random.Random, generations: int = GENERATIONS[1]) -> bytes:
    """One epoch of an island; the best packing of it."""
    n = len(sizes)
    people = [decoded(s) for s in seeds]
    if len(people) < POPULATION:
        people.append(best_fit_decreasing(sizes, list(range(n)), [], limit))
    least = -(-sum(sizes) // limit)
    while len(people) < POPULATION:  # the others start from a random order of part of the items
        some = rng.sample(range(n), n // 4)
        shelf = Shelf(limit)
        for i in some:
            shelf.best_fit(i, sizes[i])
        rest = set(range(n)).difference(some)
        people.append(best_fit_decreasing(sizes, list(rest), shelf.bins(), limit))
    score = lambda p: fitness(sizes, p, limit)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        child = crossover(people[0], rng.choice(people[1:]), sizes, limit, rng)
        other = crossover(rng.choice(people[1:]), people[0], sizes, limit, rng)
        people = sorted([*people, child, other], key=score, reverse=True)[:POPULATION]
    return coded(people[0], n)


def pack_lengths(shards: DataFrame, limit: int = LIMIT, seed: int = 5, generations: int = GENERATIONS[0]) -> DataFrame:
    """(shard, sizes binary of uint16, given binary: a first plan or null) to (shard, plan binary: bin number of each item), by islands."""
    islands = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("own", F.col("given")).withColumn("guest", F.lit(None).cast("binary"))

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    rng = random.Random(f"{seed}/{r['shard']}/{r['island']}/{number}")
                    sizes = np.frombuffer(r["sizes"], np.uint16).tolist()
                    r["own"] = evolve(sizes, [x for x in (r["own"], r.pop("guest")) if x], limit, rng, generations)
                    r["bins"] = int(np.frombuffer(r["own"], np.uint32).max()) + 1
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("own", pa.binary()), ("bins", pa.int64())]))

        return run

    # evolving is slow for its bytes: a task for few islands each, whatever their size
    parts = max(1, min(ISLANDS * shards.count(), MAX_TASKS))
    for e in range(EPOCHS):
        grown = islands.select("shard", F.col("island").cast("int").alias("island"), "sizes", "own", "guest").repartition(parts, "shard", "island").mapInArrow(epoch(e), "shard long, island int, sizes binary, own binary, bins long")
        grown = stage(grown, f"pack-epoch{e}")
        elite = grown.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("guest"))
        islands = grown.join(elite, ["shard", "island"])
    return grown.groupBy("shard").agg(F.min_by("own", F.struct("bins", "island")).alias("plan"))


def pack(docs: DataFrame, name: str = "byte_bpe_50k", limit: int = LIMIT, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    every = stage(pieces(docs, name, limit, with_ids), "pack-pieces")
    full = every.filter(F.col("length") == limit).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    part = every.filter(F.col("length") < limit)
    placed = packed_items(part.select("uid", F.col("length").cast("int").alias("n"), F.lit(None).cast("long").alias("bin")), limit, shard)
    return full.unionByName(part.join(placed, F.col("uid") == F.col("u")).drop("u"))


def packed_items(items: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """(u, sequence_id, offset) for items (uid, n, bin null): round after round over what shards hand on."""
    arrow_batches(items.sparkSession, 64)
    done, level, n = None, 0, max(1, -(-items.count() // shard))
    while True:
        own, last = _round(items, n, level, limit)
        kept = own.filter("NOT handed").select("u", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        handed = own.filter("handed")
        n, level = max(1, min(-(-handed.count() // shard), n // 2)), level + 1
        items = handed.select(F.col("u").alias("uid"), "n", F.col("sequence_id").alias("bin"))


def _round(items: DataFrame, n: int, level: int, limit: int) -> tuple[DataFrame, bool]:
    """((u, n, sequence_id, offset, handed) of items in n shards, whether none is handed on)."""
    last = n == 1
    # sequences that were handed on stay whole, so that the next search can start from them
    listed = items.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("bin", "uid"), F.lit(level)), F.lit(n)).cast("long"))
    listed = listed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uid", "n", "bin"))).alias("items"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], []]
            for own in b.column(1).to_pylist():
                cols[0].append(np.array([x["n"] for x in own], np.uint16).tobytes())
                cols[1].append(np.array([x["uid"] for x in own], np.int64).tobytes())
                cols[2].append(np.unique([x["bin"] for x in own], return_inverse=True)[1].astype(np.uint32).tobytes() if level else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.binary()) for c in cols]], names=["shard", "sizes", "uids", "given"])

    shards = stage(listed.mapInArrow(sizes, "shard long, sizes binary, uids binary, given binary"), "pack-shards")
    plans = pack_lengths(shards.select("shard", "sizes", "given"), limit, generations=GENERATIONS[level > 0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, u, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                size, uid, at = np.frombuffer(s, np.uint16).astype(np.int64), np.frombuffer(u, np.int64), np.frombuffer(p, np.uint32).astype(np.int64)
                order = np.argsort(at, kind="stable")
                before = size[order].cumsum() - size[order]
                first = np.r_[True, np.diff(at[order]) != 0]
                offset = np.empty(len(at), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                fill = np.bincount(at, size).astype(np.int64)
                emptiest = np.argsort(fill, kind="stable")[: -(-len(fill) // HANDED)]
                hand = np.zeros(len(fill), bool)
                hand[emptiest[fill[emptiest] < limit]] = not last
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(size.astype(np.int32)), pa.array((level << 52) + (k << 20) + at), pa.array(offset), pa.array(hand[at])], names=["u", "n", "sequence_id", "offset", "handed"])

    placed = shards.join(plans, "shard").select("shard", "sizes", "uids", "plan").mapInArrow(place, "u long, n int, sequence_id long, offset long, handed boolean")
    return stage(placed, f"pack-placed{level}"), last


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every piece."""
    return pack(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
