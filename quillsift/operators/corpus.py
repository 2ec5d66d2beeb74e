"""Corpus algebra: strata, proportional and round-robin picks, exclusion, aliases, checkpoints. No driver-side loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.functions import text as T
from quillsift.session import settled


def seeded(key: Column, seed: int) -> Column:
    """A repeatable order of keys."""
    return F.xxhash64(F.lit(seed), key)


def strata_quota(sizes: DataFrame, keys: list[str], target: int) -> DataFrame:
    """(keys..., n) with quota: the whole part of target * n / total, and one more for the largest remainders.

    sizes has a row per stratum, so the window over all of them stays small. Ties go to the smaller key.
    """
    whole = Window.partitionBy()
    share = F.lit(target) * F.col("n") / F.sum("n").over(whole)
    out = sizes.withColumn("_base", F.least(F.floor(share), F.col("n"))).withColumn("_rest", share - F.col("_base"))
    short = F.lit(target) - F.sum("_base").over(whole)
    room = (F.col("_base") < F.col("n")).cast("int")
    rank = F.row_number().over(Window.orderBy(F.desc(room), F.desc("_rest"), *keys))
    extra = ((rank <= short) & (room == 1)).cast("long")
    return out.withColumn("quota", F.col("_base") + extra).drop("_base", "_rest")


def proportional_sample(df: DataFrame, keys: list[str], target: int, order: Column) -> DataFrame:
    """Rows of df, quota per stratum, first by order."""
    quota = strata_quota(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, target).drop("n")
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    on = [ranked[k].eqNullSafe(quota[k]) for k in keys]
    joined = ranked.join(quota, on)
    return joined.filter("_rn <= quota").select(*[ranked[c] for c in df.columns])


def strata_key(date: Column, auth: Column) -> Column:
    """The stratum of a message: its month, and whether it has an Authentication-Results header that is not empty."""
    return F.struct(T.year_month(date).alias("year_month"), (F.coalesce(auth, F.lit("")) != "").alias("has_auth"))


def with_paths(facts: DataFrame, sample: DataFrame, key: str, path: str = "path") -> DataFrame:
    """facts with the path of the sample's row of the same key; by key, so that a message that was not parsed shifts nothing."""
    return facts.join(sample.select(key, path), key)


def pool_filter(pool: DataFrame, forced: DataFrame, key: str, blocked: list[str] | None = None) -> DataFrame:
    """Rows that may be drawn: not forced already, not known as spam, from no blocked domain, of no spam template, with a body
    that can be labelled, and with a positive signal in the audit's reason. Unknown spam status, domain and reason pass.
    """
    template = F.rlike(F.coalesce("body_text", F.lit("")), F.lit("(?iuU)" + "|".join(L.SPAM_TEMPLATES)))
    spam = F.coalesce("is_spam_not_phishing", F.lit(False))
    listed = F.coalesce(F.col("from_domain").isin(L.SPAM_INFRASTRUCTURE_DOMAINS if blocked is None else blocked), F.lit(False))
    unsure = F.startswith(F.coalesce("spam_reason", F.lit("")), F.lit(L.NO_SIGNAL_REASON))
    rest = pool.join(forced.select(key).distinct(), key, "left_anti")
    return rest.filter(~spam & ~listed & ~template & F.coalesce(T.usable_body(F.col("body_text")), F.lit(False)) & ~unsure)


def balanced_pick(df: DataFrame, label: str, halves: dict[str, int], bucket: str, within: Column, between: Column) -> DataFrame:
    """For each label so many rows, by turns over the buckets (a current verdict, say) that its rows fall in."""
    out = None
    for value, count in halves.items():
        part = stratified_pick(df.filter(F.col(label) == value), bucket, count, within, between)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0)


def checked_pick(picked: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """picked, or an error where a key is picked twice or is in another list already."""
    rows = picked.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    rows = rows.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("picked twice: "), F.col(key).cast("string"))))
    for x in others:
        rows = rows.join(x.select(key).distinct().withColumn("_held", F.lit(True)), key, "left")
        rows = rows.withColumn("_ok", F.coalesce("_ok", F.assert_true(F.col("_held").isNull(), F.concat(F.lit("held already: "), F.col(key).cast("string"))))).drop("_held")
    # the check is read by a filter, so that no plan can leave it out
    return rows.filter("_ok IS NULL").select(*picked.columns)


def review_sample(pool: DataFrame, key: str, label: str, verdict: str, halves: dict[str, int], seed: int, *excluded: DataFrame) -> DataFrame:
    """A review set: rows in none of the excluded lists, so many of each label, spread over the current verdicts."""
    rows = exclude(pool, key, *excluded)
    return checked_pick(balanced_pick(rows, label, halves, verdict, seeded(F.col(key), seed), F.col(verdict)), key, *excluded)


def stratified_pick(df: DataFrame, bucket: str, count: int, within: Column, between: Column) -> DataFrame:
    """Round-robin over buckets: the first of each bucket, then the second, until count rows."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(within))
    return df.withColumn("_turn", turn).withColumn("_b", between).orderBy("_turn", "_b").limit(count).drop("_turn", "_b")


def exclude(df: DataFrame, key: str, *lists: DataFrame) -> DataFrame:
    """Rows whose key is in none of the lists (each with the key column)."""
    out = None
    for x in lists:
        out = x.select(key) if out is None else out.unionByName(x.select(key))
    return df.join(out.distinct(), key, "left_anti") if out is not None else df


def expand(existing: DataFrame, pool: DataFrame, key: str, count: int, order: Column) -> DataFrame:
    """existing and the first count rows of pool that it does not hold."""
    new = pool.join(existing.select(key), key, "left_anti").orderBy(order).limit(count)
    return existing.unionByName(new.select(*existing.columns))


def force_include(pool: DataFrame, forced: DataFrame, key: str, keep: Column, count: int, order: Column) -> DataFrame:
    """All rows of pool whose key is forced, filled with others that pass keep up to count rows."""
    must = pool.join(forced.select(key).distinct(), key, "left_semi")
    rest = pool.join(forced.select(key).distinct(), key, "left_anti").filter(keep)
    return must.withColumn("_f", F.lit(0)).unionByName(rest.withColumn("_f", F.lit(1))).orderBy("_f", order).limit(count).drop("_f")


def attach_audit(df: DataFrame, audit: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """df with is_spam_not_phishing and spam_reason: hand-verified keys first, then the audit; null where neither knows."""
    hand = verified.select(key).distinct().withColumn("_hand", F.lit(True))
    out = df.join(audit.select(key, "likely_spam", F.col("spam_reason").alias("_reason")), key, "left").join(hand, key, "left")
    return (
        out.withColumn("is_spam_not_phishing", F.when(F.col("_hand"), F.lit(True)).otherwise(F.col("likely_spam")))
        .withColumn("spam_reason", F.when(F.col("_hand"), F.lit("hand-verified commercial spam")).otherwise(F.col("_reason")))
        .drop("likely_spam", "_reason", "_hand")
    )


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both hold: empty if the sets are disjoint."""
    return a.select(key).intersect(b.select(key))


def alias_map(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(real, ord) to (real, alias_no): first-seen numbers from 1; known aliases keep theirs and new ones follow.

    Numbering needs one order of all distinct values: they are ranked within ranges of their first place, and each
    range starts after the rows of the ranges before it, so no task sorts them all.
    """
    firsts = values.groupBy("real").agg(F.min("ord").alias("first"))
    start = F.lit(0).cast("long")
    if known is not None:
        firsts = firsts.join(known.select("real"), "real", "left_anti")
    spread = settled(firsts.repartitionByRange("first", "real").withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("first", "real"))
    new = spread.withColumn("_i", inside).join(before, "_p").select("real", (F.col("_before") + F.col("_i")).alias("alias_no"))
    if known is None:
        return new
    top = known.agg(F.coalesce(F.max("alias_no"), start).alias("_top"))
    return known.select("real", "alias_no").unionByName(new.crossJoin(F.broadcast(top)).select("real", (F.col("alias_no") + F.col("_top")).alias("alias_no")))


def file_alias(real: Column, number: Column) -> Column:
    """file-0000.ext by number from 1."""
    stem = F.format_string("file-%04d", number - 1)
    return F.when(F.contains(real, F.lit(".")), F.concat(stem, F.lit("."), F.substring_index(real, ".", -1))).otherwise(stem)


def hash_split(df: DataFrame, key: Column, valid_percent: int, seed: int) -> DataFrame:
    """df with split: train or valid, by a hash of the key."""
    return df.withColumn("split", F.when(F.pmod(seeded(key, seed), F.lit(100)) < valid_percent, "valid").otherwise("train"))


def pending(todo: DataFrame, done: DataFrame, keys: list[str], retry_errors: bool = True) -> DataFrame:
    """Rows of todo without a result; done has the keys and error. With retry_errors a failed result counts as none."""
    finished = done.filter("error IS NULL") if retry_errors else done
    return todo.join(finished.select(*keys).distinct(), keys, "left_anti")


def config_hash(*parts: Column) -> Column:
    """A key of everything that a cached result depends on."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def training_pairs(prompts: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Chat rows as JSON: system, user and assistant messages of the keys that both sides hold."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    both = prompts.join(answers, key)
    return both.select(key, F.to_json(F.struct(F.array(message("system", "system"), message("user", "prompt"), message("assistant", "answer")).alias("messages"))).alias("chat"))


def language_mix(df: DataFrame, turkish: Column) -> DataFrame:
    """One row: rows, Turkish ones, their share, and whether it is under 30 %."""
    share = F.count_if(turkish) / F.count("*")
    return df.agg(F.count("*").alias("n"), F.count_if(turkish).alias("n_turkish"), share.alias("share"), (share < 0.3).alias("warn"))
