"""N-gram Jaccard join by signature trees.

Two texts link when 100 * |A and B| >= LEAST * |A or B| over their sets of distinct N-word shingles. The join runs as:

1. Sets. Equal sets (copies) become one class, named by a 64-bit hash of the set.
2. Ties. In any fixed order of shingles, two linked sets share one of the first |A| - ceil(LEAST% of |A|) + 1 shingles.
   The order puts shingles that many texts hold last (a list of at most HOT_LIST, a matter of speed alone). Classes with
   such a shingle in common form a group; a signature tree over the group's bitmaps ties those that may link.
3. Families. Tied classes form a family; all links lie inside families. Only now are whole sets fetched, once each, and a
   signature tree over a family compares exactly the pairs that its bounds leave.
4. A group or family of more than BLOCK classes is dealt into blocks, SPREAD at most. Its smallest class visits every block, and after that
   all that its main component does not hold: no pair of classes in different components stays unseen.

A signature tree has leaves of one set and nodes of FAN children, each with the OR of the bitmaps and the range of sizes
below it. Two nodes are traversed together and dropped where the largest possible overlap cannot reach the least that the
sizes ask for, or where all below them is connected already.

Defined results: null or blank texts have an empty set and link with nothing; texts of fewer than N words have one shingle, the
whole sequence; repeated rows are linked by their equal sets; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.bytehash import U64, flat, mix, slices, word_hashes
from quillsift.llm.common import arrow_batches, merged, packed, row_key, stage
from quillsift.llm.components import components

#: The query's contract, and what the pipeline's stage takes.
N, LEAST = 4, 85
STAGE_N, STAGE_LEAST = 5, 80
#: Shingles whose hash lies below this share of the hash space can be told common or rare.
KNOWN = U64(1 << 62)
HOT_LIST, HOT_COUNT = 50_000, 32
BLOCK, FAN = 256, 8
GUESTS = 256
#: Blocks of a group, and parts of its guests, at most: every one of them costs a copy of the other side. Whole sets, which
#: take more memory than bitmaps, are dealt finer.
SPREAD, SPREAD_SETS = 16, 64
_STEPS = mix(np.arange(1, 9, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """A rising array of distinct shingle hashes for each text."""
    starts, ends = offsets[:-1], offsets[1:]
    words, first, stop = word_hashes(data, starts, ends)
    m = max(len(words) - n + 1, 0)
    shingles = mix(sum((words[i : i + m] * _STEPS[i] for i in range(n)), np.zeros(m, U64)))
    out = []
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(shingles[a : b - n + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _STEPS[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def _sets(batch_text: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, offsets = flat(batch_text)
    for lo, hi in slices(offsets):
        yield from shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)


def prefix_length(size: int, least: int = LEAST) -> int:
    """How many shingles of a set of this size must hold one of any linked set, in any fixed order."""
    return size - -(-least * size // 100) + 1


def hot_shingles(docs: DataFrame, n: int = N) -> np.ndarray:
    """The shingles below KNOWN that most texts hold, HOT_LIST at most, rising.

    Tasks count over all their texts and report what they saw twice; the sums are lower bounds of the counts, which is
    enough for an order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        keys, counts, held = np.empty(0, U64), np.empty(0, np.int64), 0

        def merge() -> None:
            nonlocal keys, counts, held
            if parts:
                every = np.concatenate([keys, *parts])
                weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
                keys, back = np.unique(every, return_inverse=True)
                counts = np.bincount(back, weight, len(keys)).astype(np.int64)
                parts.clear()
            held = 0

        for b in batches:
            for s in _sets(b.column(0), n):
                parts.append(s[: np.searchsorted(s, KNOWN)].copy())
                held += len(parts[-1])
            if held > 2_000_000:
                merge()
        merge()
        more = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[more].view(np.int64)), pa.array(counts[more])], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "shingle").limit(HOT_LIST).select("shingle").toArrow()
    return np.sort(np.asarray(hot.column(0), np.int64).view(U64))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in a map of at least twice as many bits, a power of two."""
    width = 256
    while width < 2 * len(s):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(s & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


_SIGS = "doc_id long, k long, size long, s long, prefix array<long>, bits binary"


def signatures(docs: DataFrame, hot: np.ndarray, n: int = N, least: int = LEAST) -> DataFrame:
    """Per (doc_id, k, text): set size, set hash s (null if empty) and the prefix of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, name, bits, lengths, values = [], [], [], [0], [np.empty(0, U64)]
            for s in _sets(b.column(2), n):
                size.append(len(s))
                name.append(int(np.append(mix(s), mix(np.array([len(s)], U64))).sum().view(np.int64)) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
                if len(s):
                    cut = int(np.searchsorted(s, KNOWN))
                    low = s[:cut]
                    common = np.zeros(cut, bool)
                    if len(hot) and cut:
                        common = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
                    s = np.concatenate([low[~common], s[cut:], low[common]])[: prefix_length(len(s), least)]
                lengths.append(lengths[-1] + len(s))
                values.append(s)
            prefix = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(name, pa.int64()), prefix, pa.array(bits, pa.binary())], names=["doc_id", "k", "size", "s", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "k", "text").mapInArrow(run, _SIGS)


class Member:
    """A class in a tree: its name, size, bitmap (an int), and its set where that is known."""

    __slots__ = ("name", "size", "maps", "width", "shingles")

    def __init__(self, name: int, size: int, bits: bytes, shingles: np.ndarray | None = None):
        self.name, self.size, self.shingles = name, size, shingles
        self.width = 8 * len(bits)
        self.maps = {self.width: int.from_bytes(bits, "little")}

    def at(self, width: int) -> int:
        """The bitmap folded to a width."""
        if width not in self.maps:
            wide = self.at(2 * width)
            self.maps[width] = (wide >> width) | (wide & ((1 << width) - 1))
        return self.maps[width]


def _enough(shared: int, least_a: int, least_b: int, most_a: int, most_b: int, least: int) -> bool:
    """Whether sets of such sizes may link when they share at most so many shingles."""
    need = (least * (least_a + least_b) + 99 + least) // (100 + least)
    return shared >= need and 100 * most_a >= least * least_b and 100 * most_b >= least * least_a


def may_link(a: Member, b: Member, least: int = LEAST) -> bool:
    """False only if the bitmaps prove that a and b do not link."""
    width = min(a.width, b.width)
    x, y = a.at(width), b.at(width)
    both = (x & y).bit_count()
    # shingles of one set that lie on bits of the other: those bits, and what shares a bit within the set
    shared = both + min(a.size - x.bit_count(), b.size - y.bit_count())
    return _enough(min(shared, a.size, b.size), a.size, b.size, a.size, b.size, least)


def do_link(a: Member, b: Member, least: int = LEAST) -> bool:
    """Whether a and b link, by their whole sets."""
    if not may_link(a, b, least):
        return False
    x, y = (a.shingles, b.shingles) if a.size <= b.size else (b.shingles, a.shingles)
    inter = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * inter >= least * (len(x) + len(y) - inter)


class Tree:
    """Levels of nodes over members: (OR of bitmaps, least size, most size, most shingles that share a bit with another)."""

    def __init__(self, members: list[Member], width: int):
        rows = [(m.at(width), m.size, m.size, m.size - m.at(width).bit_count()) for m in members]
        self.levels = [rows]
        while len(rows) > 1:
            rows = [self.above(rows[i : i + FAN]) for i in range(0, len(rows), FAN)]
            self.levels.append(rows)

    @staticmethod
    def above(rows: list[tuple]) -> tuple:
        maps = 0
        for r in rows:
            maps |= r[0]
        return maps, min(r[1] for r in rows), max(r[2] for r in rows), max(r[3] for r in rows)


class Union:
    """Disjoint sets of labels."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def tree_links(members: list[Member], union: Union, test, guests: list[Member] | None = None, least: int = LEAST) -> list[tuple[int, int]]:
    """Pairs that pass the test and join two sets of `union`, as many as connect all pairs that pass.

    With guests, these are held against the members only, not against each other.
    """
    out: list[tuple[int, int]] = []

    def meet(x: Member, y: Member) -> None:
        if x.name != y.name and union.find(x.name) != union.find(y.name) and test(x, y, least):
            union.join(x.name, y.name)
            out.append((x.name, y.name))

    key = lambda m: (m.at(256) & 0xFFFF, m.size)
    own = sorted(members, key=key)
    other = own if guests is None else sorted(guests, key=key)
    width = min(m.width for m in [*own, *other])
    a = Tree(own, width)
    b = a if guests is None else Tree(other, width)
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        u, i, v, j = stack.pop()
        if u == v == 0:
            meet(own[i], other[j])
            continue
        labels = {union.find(m.name) for m in own[i * FAN**u : (i + 1) * FAN**u]}
        if len(labels) == 1 and labels == {union.find(m.name) for m in other[j * FAN**v : (j + 1) * FAN**v]}:
            continue
        u2, v2 = max(u - 1, 0), max(v - 1, 0)
        left = range(i * FAN, min((i + 1) * FAN, len(a.levels[u2]))) if u else (i,)
        right = range(j * FAN, min((j + 1) * FAN, len(b.levels[v2]))) if v else (j,)
        pairs = []
        for x in left:
            ma, la, ha, xa = a.levels[u2][x]
            for y in right:
                if guests is None and (y < x or (y == x and u2 == 0)):
                    continue
                mb, lb, hb, xb = b.levels[v2][y]
                shared = min((ma & mb).bit_count() + min(xa, xb), ha, hb)
                if _enough(shared, la, lb, ha, hb, least):
                    pairs.append((u2, x, v2, y))
        # nearest neighbours come first: their links make others needless
        stack += sorted(pairs, key=lambda p: -abs(p[1] - p[3]))
    return out


def _grouped(rows: DataFrame, keys: list[str], exact: bool, least: int) -> DataFrame:
    """Rows (keys..., guest, s, root, size, load) to links (a, b): a tree visit for each group, read in key order.

    load is the set's bitmap, or the set itself where the test is exact.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)

        def member(r: tuple) -> Member:
            if not exact:
                return Member(r[n + 1], r[n + 3], r[n + 4])
            s = np.frombuffer(r[n + 4], U64)
            return Member(r[n + 1], len(s), bitmap(s), s)

        out: list[tuple[int, int]] = []
        union = Union()
        for _, group in groupby(stream(), key=lambda r: r[:n]):
            got = {(r[n], r[n + 1]): r for r in group}
            if len(got) < 2:
                continue
            for r in got.values():
                if r[n + 1] != r[n + 2]:
                    union.join(r[n + 1], r[n + 2])
            hosts = [member(r) for r in got.values() if not r[n]]
            guests = [member(r) for r in got.values() if r[n]]
            out += tree_links(hosts, union, do_link if exact else may_link, guests or None, least)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
            if len(union.parent) > 1_000_000:
                union = Union()
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    dealt = rows.select(*keys, "guest", "s", "root", "size", "load").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def sweep(rows: DataFrame, exact: bool, least: int, block: int, name: str) -> DataFrame:
    """Links (a, b) that connect all pairs of each group g that pass the test.

    rows: g, s, size, load, and of the group: m (how many rows) and pivot (its smallest s).
    """
    spread = SPREAD_SETS if exact else SPREAD
    placed = rows.withColumn("blocks", F.least(F.ceil(F.col("m") / block), F.lit(spread)).cast("int")).withColumn("block", F.pmod(F.xxhash64("s", F.lit(3)), F.col("blocks")).cast("int"))
    placed = stage(placed.withColumn("root", F.col("s")).drop("m"), f"jaccard-{name}")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["g", "block", "guest", "s", "root", "size", "load"]
    large = placed.filter("blocks > 1")
    pivots = large.filter("s = pivot").withColumn("block", every)
    first = placed.unionByName(pivots).withColumn("guest", F.lit(0))
    found = stage(_grouped(first.select(cols), ["g", "block"], exact, least), f"jaccard-{name}-links")
    if large.isEmpty():
        return found
    comp = components(found)
    labelled = merged(large, comp.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("root", F.coalesce("component", "s")).drop("component")
    sizes = labelled.groupBy("g", "root").agg(F.count("*").alias("_c"))
    main = sizes.groupBy("g").agg(F.max_by("root", F.struct("_c", "root")).alias("_main"))
    labelled = stage(labelled.join(main, "g"), f"jaccard-{name}-labelled")
    outside = labelled.filter(F.col("root") != F.col("_main"))
    if outside.isEmpty():
        return found
    n_guests = outside.groupBy("g").agg(F.least(F.ceil(F.count("*") / GUESTS), F.lit(spread)).cast("int").alias("_g"))
    guests = outside.join(n_guests, "g").withColumn("part", F.pmod(F.xxhash64("s", F.lit(4)), F.col("_g")).cast("int")).withColumn("block", every)
    hosts = labelled.join(n_guests, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    cols = ["g", "block", "part", "guest", "s", "root", "size", "load"]
    second = guests.withColumn("guest", F.lit(1)).select(cols).unionByName(hosts.withColumn("guest", F.lit(0)).select(cols))
    return found.unionByName(stage(_grouped(second, ["g", "block", "part"], exact, least), f"jaccard-{name}-more"))


def _shingle_bytes(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(g, s, m, pivot, load) of the texts k that are wanted; load is the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([s.tobytes() for s in _sets(b.column(4), n)], pa.binary())], names=["g", "s", "m", "pivot", "load"])

    return docs.join(wanted, "k").select("g", "s", "m", "pivot", "text").mapInArrow(run, "g long, s long, m long, pivot long, load binary")


def links(docs: DataFrame, sigs: DataFrame, n: int = N, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that link with another class."""
    one = sigs.filter("s IS NOT NULL").groupBy("s").agg(F.min("u").alias("u"))
    # one copy speaks for its class, else copies would count as members of the groups
    tokens = stage(merged(sigs.select("u", "s", "prefix"), one.select("u"), "u").select("s", "prefix"), "jaccard-prefixes").select("s", F.explode("prefix").alias("g"))
    counted = tokens.groupBy("g").agg(F.count("*").alias("m"), F.min("s").alias("pivot"), F.max("s").alias("last")).filter("pivot < last")
    counted = stage(counted, "jaccard-counted")
    # most groups are two classes, which share many shingles: one group for each pair, from the counts alone
    pairs = counted.filter("m = 2").select("pivot", "last").distinct().withColumn("g", F.xxhash64(F.lit(2), "pivot", "last"))
    held = merged(tokens, counted.filter("m > 2").select("g", "m", "pivot"), "g")
    held = held.unionByName(pairs.select(F.explode(F.array("pivot", "last")).alias("s"), "g", F.lit(2).cast("long").alias("m"), "pivot"))
    reps = merged(sigs.select("u", "k", "size", "bits"), one, "u")
    ties = sweep(merged(stage(held, "jaccard-shared"), reps.select("s", "size", F.col("bits").alias("load")), "s"), False, least, block, "ties")
    family = stage(components(ties).select(F.col("node").alias("s"), F.col("component").alias("g")), "jaccard-families")
    many = family.groupBy("g").agg(F.count("*").alias("m"), F.min("s").alias("pivot"))
    wanted = merged(merged(sigs.select("u", "k"), merged(one, family, "s"), "u").drop("u"), many, "g")
    # identical rows share k: one of them is enough
    sets = _shingle_bytes(docs.select("k", "text"), wanted, n).dropDuplicates(["s"]).withColumn("size", F.lit(0))
    return components(sweep(sets, True, least, block, "sets"))


def labelled(docs: DataFrame, n: int = N, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """join's columns, and label: the component itself, which doc_ids that occur more than once do not tell."""
    arrow_batches(docs.sparkSession)
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("k"), "text")
    sigs = stage(signatures(keyed, hot_shingles(keyed, n), n, least).withColumn("u", F.monotonically_increasing_id()), "jaccard-signatures")
    comp = links(keyed, sigs, n, least, block)
    classes = sigs.filter("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_copies"))
    named = merged(classes, comp.select(F.col("node").alias("s"), "component"), "s", "left")
    named = stage(named.filter("component IS NOT NULL OR _copies > 1").withColumn("component", F.coalesce("component", "s")), "jaccard-classes")
    least_id = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    by_class = stage(merged(named, least_id, "component").select("s", "component", "component_id"), "jaccard-names")
    out = merged(sigs.drop("prefix", "bits"), by_class, "s", "left")
    return out.select("doc_id", "k", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "s").alias("label"))


def join(docs: DataFrame, n: int = N, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, k, n_shingles, component_id) of (doc_id, text): a row per row; k is the row's content key."""
    return labelled(docs, n, least, block).drop("label")


def keep_one(docs: DataFrame, n: int = STAGE_N, least: int = STAGE_LEAST) -> DataFrame:
    """docs with one row of each component: the row of its smallest doc_id. Rows with an empty set all stay."""
    found = labelled(docs.select("doc_id", "text"), n, least)
    first = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("_f"))
    stay = first.select(F.col("_f.k").alias("k"), F.lit(False).alias("_all"))
    stay = stage(stay.unionByName(found.filter("n_shingles = 0").select("k", F.lit(True).alias("_all")).distinct()), "jaccard-stay")
    keyed = packed(docs, "doc_id", "text").withColumn("_k", row_key("doc_id", "text"))
    kept = keyed.join(stay.hint("merge"), F.col("_k") == F.col("k"))
    # identical rows share k
    order = Window.partitionBy("_k").orderBy("doc_id")
    kept = kept.withColumn("_i", F.row_number().over(order)).filter("_i = 1 OR _all")
    return kept.select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return join(docs.select("doc_id", "text"), N, LEAST).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(z) AS c FROM r GROUP BY doc_id) AS m USING (doc_id)
"""
