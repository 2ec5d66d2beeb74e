"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Words and totals per source (one narrow scan; the totals are pre-aggregated map-side).
2. Targets: weights 1, 2, 3, repeating over the sources by code point (null last); a source's target stops at
   MAX_EPOCHS times its size and the excess is shared again by weight until none is above: a water level that rises with
   each round of sums over the sources that are still below their limit.
3. Seats: the total is cut into blocks of equal size. Blocks go to sources by the highest quotients target / (2k + 1);
   a source's blocks go to its shards (seeded slices of bounded size) the same way, by their sizes. A divisor is narrowed
   in rounds of sums until few seats are open; the highest remaining quotients decide these. No window spans all sources or
   all shards of a source, but for rows that tie at the last quotient.
4. In a shard the documents are laid on a line in seeded order, up to MAX_EPOCHS times over; the shard's blocks are the
   first of that line. A document takes the words that these blocks cover: the last block may end inside it. For whole
   documents, `copies` counts the laps in which its middle is covered.

Defined results: null texts have size 0 and are never taken; repeated rows are separate documents; an empty table gives
an empty result; reruns agree as the order is a hash of the seed and the row's content, then doc_id. A text of any length is one
row. Extra columns, also such with clashing names, are kept by mixed_documents and ignored by mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import WORD, packed, row_key, stage, staged

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SHARD_WORDS = 2_000_000
SHARD_DOCS = 1024
BLOCK_WORDS = 4
#: Tables of sources up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000
SEED = 20
#: Of the search for a divisor: values looked at in a round, rounds, and the share by which bounds are kept apart from rounding.
PROBES, ROUNDS, SLACK = 32, 3, 1e-12


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes (source, ...) with _i: 0, 1, ... by code point, null last; sorted in ranges, so not in one task."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    dealt = stage(sizes.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_i", own).join(ranges, "_p").withColumn("_i", (F.col("_i") + F.col("_b")).cast("long")).drop("_p", "_b")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, ...) with _i, weight, cap and target."""
    ranked = numbered(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double"))
    ranked = stage(ranked.withColumn("cap", F.col("source_size").cast("double") * MAX_EPOCHS), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1
    while True:  # each round takes further sources out; with none left out anew the level stands
        full = F.col("cap") < level * F.col("weight")
        got = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if got[0] == above or not got[2]:
            break
        above, level = got[0], (total - got[1]) / got[2]
    return ranked.withColumn("target", F.least("cap", F.lit(float(level)) * F.col("weight")))


def apportion(votes: DataFrame, group: str, vote: str, seats: str, out: str, tie: str) -> DataFrame:
    """Sainte-Lague: `out` = whole seats of each row of a group, `seats` in all, by the highest quotients vote / (2k + 1).

    A row has its first s seats at a divisor d where vote / d >= s - 1/2. With m = 1 / d the seats at m are at most, and
    those at a larger one more than, what a group has; ROUNDS rounds of sums at PROBES values bring the two together. Seats
    between them, among which all ties at the last quotient are, go by quotient, then by `tie`. Rows without a vote get none.
    """
    at = lambda m: F.floor(F.col(vote) * m + 0.5).cast("long")
    some = votes.filter(F.col(vote) > 0)
    half = F.count("*") / 2
    low, high = F.greatest((F.first(seats) - half) / F.sum(vote), F.lit(0.0)), (F.first(seats) + half + 1) / F.sum(vote)
    bounds = stage(some.groupBy(group).agg(F.first(seats).alias("_all"), (low * (1 - SLACK)).alias("_lo"), (high * (1 + SLACK)).alias("_hi")), "mix-bounds")
    step = lambda j: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * j / PROBES
    for _ in range(ROUNDS):
        probes = some.select(group, vote).join(bounds, group).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(PROBES))))
        sums = probes.groupBy(group, "_all", "_lo", "_hi", "_j").agg(F.sum(at(step(F.col("_j")))).alias("_s"))
        fits = (F.col("_s") <= F.col("_all")) | (F.col("_j") == 0)
        kept = sums.groupBy(group, "_all", "_lo", "_hi").agg(F.max(F.when(fits, F.col("_j"))).alias("_j"))
        bounds = stage(kept.select(group, "_all", step(F.col("_j")).alias("_lo"), F.when(F.col("_j") == PROBES, F.col("_hi")).otherwise(step(F.col("_j") + 1)).alias("_hi")), "mix-bounds")
    placed = votes.join(bounds.drop("_all"), group, "left")
    placed = placed.withColumn("_s", F.coalesce(at(F.col("_lo") * (1 - SLACK)), F.lit(0))).withColumn("_most", F.coalesce(at(F.col("_hi") * (1 + SLACK)), F.lit(0)))
    placed = stage(placed.drop("_lo", "_hi"), "mix-seats")
    left = placed.groupBy(group).agg((F.first(seats) - F.sum("_s")).alias("_left"))
    open_ = placed.filter((F.col("_most") > F.col("_s")) & (F.col(vote) > 0)).select(group, tie, vote, F.explode(F.sequence(F.col("_s"), F.col("_most") - 1)).alias("_k"))
    rank = Window.partitionBy(group).orderBy(F.desc(F.col(vote) / (2 * F.col("_k") + 1)), tie, "_k")
    won = open_.withColumn("_r", F.row_number().over(rank)).join(left, group).filter("_r <= _left").groupBy(group, tie).agg(F.count("*").alias("_w"))
    won = won.select(F.col(group).alias("_g"), F.col(tie).alias("_t"), "_w")
    out_ = placed.join(won, (F.col(group) == F.col("_g")) & (F.col(tie) == F.col("_t")), "left")
    return out_.withColumn(out, F.col("_s") + F.coalesce("_w", F.lit(0))).drop("_s", "_most", "_g", "_t", "_w")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    taken: the words that the mix takes of the document, repeats counted, at most MAX_EPOCHS * size; copies: how often
    it comes into a mix of whole documents.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), row_key("doc_id", "text")))
    narrow = stage(sized.select("doc_id", "source", "size", "_h"), "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    n_shards = F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("_docs") / SHARD_DOCS, F.lit(1.0))).cast("long")
    shared = staged(spark, "mix-targets", lambda: targets(totals.withColumn("_n", n_shards).drop("_docs"), weights))
    few = shared.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast(shared) if few else shared
    at = lambda d: d.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = at(narrow).withColumn("_shard", F.pmod(F.col("_h"), F.col("_n")))

    def quotas() -> DataFrame:
        total = shared.agg(F.sum("target")).first()[0] or 0.0
        seats = shared.select("_i", "target", F.lit(round(total / block)).alias("_all"), F.lit(0).alias("_one"))
        by_source = apportion(seats, "_one", "target", "_all", "_blocks", "_i").select("_i", "_blocks")
        shards = placed.groupBy("_i", "_shard").agg(F.sum("size").alias("shard_size"))
        by_shard = apportion(shards.join(by_source, "_i"), "_i", "shard_size", "_blocks", "_quota", "_shard")
        return by_shard.select(F.col("_i").alias("_source"), F.col("_shard").alias("_at"), "_quota", "shard_size")

    quota = staged(spark, "mix-quotas", quotas)

    line = Window.partitionBy("_i", "_shard").orderBy("_h", "doc_id")
    laid = placed.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(quota, (F.col("_i") == F.col("_source")) & (F.col("_shard") == F.col("_at")))
    goal = F.col("_quota") * F.lit(block)
    lap = lambda t: goal - F.col("_end") + F.col("size") - t * F.col("shard_size")
    taken = sum(F.least(F.greatest(lap(t), F.lit(0)), F.col("size")) for t in range(MAX_EPOCHS))
    copies = sum(((F.col("size") > 0) & (2 * lap(t) >= F.col("size"))).cast("int") for t in range(MAX_EPOCHS))
    laid = laid.withColumn("taken", taken.cast("long")).withColumn("copies", copies)
    return laid.select("doc_id", "source", "size", "_h", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with docs' own columns."""
    seed = how.get("seed", SEED)
    plan = mix(docs.select("doc_id", "text", "source"), **how).filter("copies > 0").groupBy("doc_id", "_h").agg(F.sum("copies").cast("int").alias("_sum"))
    plan = stage(plan.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_kk"), "_sum"), "mix-plan")
    keyed = packed(docs, "doc_id", "text").withColumn("_k", F.xxhash64(F.lit(seed), row_key("doc_id", "text")))
    joined = keyed.join(plan, (F.col("_k") == F.col("_kk")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # identical rows share a key and a sum: the first of them stands for all
    same = Window.partitionBy("_k", "doc_id").orderBy("_sum")
    first = joined.withColumn("_i", F.row_number().over(same)).filter("_i = 1")
    return first.withColumn("_t", F.explode(F.sequence(F.lit(1), "_sum"))).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
