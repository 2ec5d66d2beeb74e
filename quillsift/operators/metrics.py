"""Evaluation as conditional aggregates and joins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.session import ship


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def verdict_metrics(df: DataFrame, verdict: str = "verdict", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Strict and wide recall, strict false positives, flagged rate and abstention; null rates without rows of a class."""
    v, y = F.col(verdict), F.col(label)
    n = lambda c: F.count_if(c)
    bad, good = y == "phishing", y == "legitimate"
    rate = lambda a, b: a / F.nullif(b, F.lit(0).cast("long"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), n(bad).alias("n_phishing"), n(good).alias("n_legitimate"),
        rate(n(bad & (v == L.PHISHING)), n(bad)).alias("recall_strict"), rate(n(bad & (v != L.CLEAN)), n(bad)).alias("recall_wide"),
        rate(n(good & (v == L.PHISHING)), n(good)).alias("fp_strict"), rate(n(good & (v != L.CLEAN)), n(good)).alias("flagged"),
        rate(n(v == L.LIKELY), F.count("*")).alias("abstention"),
    )


def ternary_truth(df: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per engine (column engine, verdict): hits over phishing, false positives over the rest; unclear rows are named and left out."""
    joined = df.join(truth.select(key, "truth"), key, "left")
    t = F.coalesce("truth", F.raise_error(F.lit("a row without ground truth")).cast("string"))
    joined = joined.withColumn("t", t)
    hit = F.col("verdict") == L.PHISHING
    return joined.groupBy("engine").agg(
        F.count_if(F.col("t") == "unclear").alias("excluded"), F.count_if(F.col("t") == "phishing").alias("n_phishing"), F.count_if((F.col("t") == "phishing") & hit).alias("caught"),
        F.count_if(F.col("t") == "spam").alias("n_spam"), F.count_if((F.col("t") == "spam") & hit).alias("spam_flagged"),
    )


def type_confusion(truth: DataFrame, found: DataFrame, candidates: DataFrame, types: DataFrame) -> DataFrame:
    """Per type tp, fp, fn, precision, recall, f1 over distinct (candidate, type) of both sides."""
    grid = candidates.select("candidate").distinct().join(F.broadcast(types.select("type")), how="cross")  # types: nine rows
    mark = lambda df, name: df.select("candidate", "type").distinct().withColumn(name, F.lit(True))
    both = grid.join(mark(truth, "_t"), ["candidate", "type"], "left").join(mark(found, "_p"), ["candidate", "type"], "left")
    t, p = F.coalesce("_t", F.lit(False)), F.coalesce("_p", F.lit(False))
    out = both.groupBy("type").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return with_scores(out)


def with_scores(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1, 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def micro_macro(per_type: DataFrame) -> DataFrame:
    """One row: micro scores, and means over the types that occur on either side."""
    s = per_type.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col(c))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return with_scores(s)


def iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over union of two spans."""
    inter = F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))
    union = (a2 - a1) + (b2 - b1) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def _overlap(a: tuple[int, int], b: tuple[int, int]) -> float:
    inter = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    union = a[1] - a[0] + b[1] - b[0] - inter
    return inter / union if union > 0 else 0.0


def assignment(cost: list[list[int]]) -> list[int]:
    """The column of each row, all different, of least total cost; there are no more rows than columns (Kuhn and Munkres)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    up, left, row_of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        slack: list[int | None] = [None] * (m + 1)
        before, seen = [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            seen[at] = True
            own, step, to = row_of[at], None, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    more = cost[own - 1][j - 1] - up[own] - left[j]
                    if slack[j] is None or more < slack[j]:
                        slack[j], before[j] = more, at
                    if step is None or slack[j] < step:
                        step, to = slack[j], j
            for j in range(m + 1):
                if seen[j]:
                    up[row_of[j]] += step
                    left[j] -= step
                elif slack[j] is not None:
                    slack[j] -= step
            at = to
        while at:
            row_of[at] = row_of[before[at]]
            at = before[at]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def best_matching(truth: list[tuple[int, int]], found: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs of greatest total overlap, as many as the shorter side has.

    Among equal totals (to 12 places) those of the earlier true spans win, then those that give these the earlier found ones:
    digits below the overlap's in one whole number, so that one assignment settles all.
    """
    t, f = len(truth), len(found)
    if not t or not f:
        return []
    score = [[_overlap(a, b) for b in found] for a in truth]
    columns = f**t
    rows = columns << t
    gain = [[round(score[i][j] * 10**12) * rows + (1 << (t - 1 - i)) * columns + (f - 1 - j) * f ** (t - 1 - i) for j in range(f)] for i in range(t)]
    if t <= f:
        pairs = list(enumerate(assignment([[-x for x in row] for row in gain])))
    else:
        pairs = sorted((i, j) for j, i in enumerate(assignment([[-gain[i][j] for i in range(t)] for j in range(f)])))
    return [(i, j, score[i][j]) for i, j in pairs]


def match_spans(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(candidate, type, gt_start, gt_end, start, end, iou) of both sides' spans (candidate, type, start, end); unmatched ones have nulls."""
    ship(truth.sparkSession)
    t = truth.groupBy("candidate", "type").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("t"))
    p = found.groupBy("candidate", "type").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("p"))
    pairs = "array<struct<gt_start:int,gt_end:int,start:int,end:int,iou:double>>"

    @F.pandas_udf(pairs)
    def solve(ts: pd.Series, ps: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(ts, ps, strict=True):
            a = [(int(x["start"]), int(x["end"])) for x in (a if a is not None else [])]
            b = [(int(x["start"]), int(x["end"])) for x in (b if b is not None else [])]
            got = best_matching(a, b)
            rows = [{"gt_start": a[i][0], "gt_end": a[i][1], "start": b[j][0], "end": b[j][1], "iou": s} for i, j, s in got]
            used, hit = {i for i, _, _ in got}, {j for _, j, _ in got}
            rows += [{"gt_start": x[0], "gt_end": x[1], "start": None, "end": None, "iou": None} for i, x in enumerate(a) if i not in used]
            rows += [{"gt_start": None, "gt_end": None, "start": x[0], "end": x[1], "iou": None} for j, x in enumerate(b) if j not in hit]
            out.append(rows)
        return pd.Series(out)

    both = t.join(p, ["candidate", "type"], "full")
    return both.select("candidate", "type", F.explode(solve("t", "p")).alias("m")).select("candidate", "type", "m.*")


def span_quality(matched: DataFrame) -> DataFrame:
    """One row: mean, median and coverage-adjusted overlap, exact, containing and disjoint shares, unmatched counts."""
    pair, x = F.col("iou").isNotNull(), F.col("iou")
    inside = ((F.col("start") <= F.col("gt_start")) & (F.col("end") >= F.col("gt_end"))) | ((F.col("gt_start") <= F.col("start")) & (F.col("gt_end") >= F.col("end")))
    n, n_t = F.count_if(pair), F.count_if(F.col("gt_start").isNotNull())
    return matched.agg(
        n.alias("matched"), F.avg(x).alias("mean_iou"), F.expr("percentile(iou, 0.5)").alias("median_iou"), ratio(F.coalesce(F.sum(x), F.lit(0.0)), n_t).alias("adjusted_mean"),
        ratio(F.count_if(x == 1.0), n).alias("exact_rate"), ratio(F.count_if(pair & inside), n).alias("containment_rate"), ratio(F.count_if(x == 0.0), n).alias("zero_rate"),
        F.count_if(F.col("start").isNull()).alias("unmatched_truth"), F.count_if(F.col("gt_start").isNull()).alias("unmatched_found"),
    )


def false_finding_rate(candidates: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per axis (candidate, axis): candidates, and those with a finding of a type that the truth does not have there."""
    wrong = found.join(truth.select("candidate", "type").distinct(), ["candidate", "type"], "left_anti").select("candidate").distinct().withColumn("_w", F.lit(1))
    joined = candidates.join(wrong, "candidate", "left")
    return joined.groupBy("axis").agg(F.count("*").alias("n"), F.count("_w").alias("n_false")).withColumn("rate", ratio(F.col("n_false"), F.col("n")))


_COUNT_SIGNALS = tuple(s for _, names in L.CLAIMS for s in names if s.endswith("_count"))


def groundedness(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """claims (with the signal columns beside each) with grounded: a claimed fact is backed by a signal, and its first number fits.

    Signals are cast to strings: true, a number above 0, or any other text but the empty one counts as given.
    """
    keys = F.flatten(F.filter(F.array(*[F.when(F.col(claim).rlike("(?iuU)" + p), F.array(*map(F.lit, s))) for p, s in L.CLAIMS]), lambda k: k.isNotNull()))
    names = sorted({s for _, group in L.CLAIMS for s in group} & set(claims.columns))
    value = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    counts = F.filter("_keys", lambda k: F.endswith(k, F.lit("_count")))
    number = F.regexp_extract(claim, r"(\d+)", 1)
    fits = F.exists(counts, lambda k: F.coalesce(F.col("_values")[k] == F.ltrim(number, F.lit("0")), F.lit(False)) | ((number.rlike("^0+$")) & F.coalesce(F.col("_values")[k] == "0", F.lit(False))))
    checked = (number == "") | (F.size(counts) == 0) | fits
    given = F.exists("_keys", lambda k: F.coalesce(~F.col("_values")[k].isin("false", "0", ""), F.lit(False)))
    out = claims.withColumn("_keys", keys).withColumn("_values", value)
    return out.withColumn("grounded", (F.size("_keys") > 0) & checked & given).drop("_keys", "_values")


def claim_ratio(checked: DataFrame, by: list[str]) -> DataFrame:
    """Share of grounded claims."""
    return checked.groupBy(*by).agg(F.count_if("grounded").alias("grounded_claims"), F.count("*").alias("total_claims")).withColumn("ratio", F.col("grounded_claims") / F.col("total_claims"))


def model_eval(results: DataFrame, by: list[str]) -> DataFrame:
    """Schema validity, verdict echo and mean groundedness of generated reports."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("schema_valid").cast("double")).alias("schema_rate"), F.avg((F.col("verdict") == F.col("expected")).cast("double")).alias("echo_rate"), F.avg("groundedness").alias("mean_groundedness"))


def reliability(results: DataFrame) -> DataFrame:
    """Per rule verdict: runs, hard failures, semantic and narrative outcomes, upgrades."""
    n = lambda c: F.count_if(c)
    return results.groupBy("rule_verdict").agg(
        F.count("*").alias("runs"), n("workflow_hard_failure").alias("hard_failures"), n(F.col("semantic_status") == "failed").alias("semantic_failed"),
        n(F.col("narrative_status") == "failed_fallback").alias("narrative_fallback"), n((F.col("semantic_status") != "failed") & (F.col("narrative_status") == "failed_fallback")).alias("narrative_only_failed"),
        n(F.col("final_verdict") != F.col("rule_verdict")).alias("changed"),
    )


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def shadow_agreement(rows: DataFrame, backends: list[str], threshold: float = 0.5) -> DataFrame:
    """Per (backend, language): usable rows, recall and false positives against the rule verdict, skip rate."""
    part = F.explode(F.array(*[F.struct(F.lit(b).alias("backend"), F.col(f"{b}_usable").alias("usable"), F.col(f"{b}_prob").alias("prob")) for b in backends]))
    long = rows.select("language", "rule_verdict", part.alias("b")).select("language", "rule_verdict", "b.*")
    flag, bad = F.col("usable") & (F.col("prob") >= threshold), F.col("rule_verdict") == L.PHISHING
    return long.groupBy("backend", "language").agg(
        F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), F.count_if(flag & bad).alias("agreed"), F.count_if(F.col("usable") & bad).alias("n_bad"),
        F.count_if(flag & ~bad).alias("false_positives"), F.count_if(~F.col("usable")).alias("skipped"),
    )


def ensembles(rows: DataFrame, backends: list[str], threshold: float = 0.5) -> DataFrame:
    """rows with the mean and the two-vote majority of all backends; null where one is not usable."""
    usable = reduce(lambda a, b: a & b, [F.col(f"{b}_usable") for b in backends])
    mean = reduce(lambda a, b: a + b, [F.col(f"{b}_prob") for b in backends]) / len(backends)
    votes = reduce(lambda a, b: a + b, [(F.col(f"{b}_prob") >= threshold).cast("int") for b in backends])
    return (
        rows.withColumn("ensemble_mean_usable", usable).withColumn("ensemble_mean_prob", F.when(usable, mean))
        .withColumn("ensemble_majority_usable", usable).withColumn("ensemble_majority_prob", F.when(usable, (votes >= 2).cast("double")))
    )


def index_percentile(values: Column, p: float) -> Column:
    """sorted[int(n * p)] of an array, its last value at most."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.floor(F.size(ordered) * p) + 1, F.size(ordered)).cast("int"))


def soak_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Requests, failures and the least, middle and greatest seconds of the good ones, per group."""
    good = F.collect_list(F.when(~F.col("hard_failure"), F.col("elapsed_seconds")))
    out = runs.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if("hard_failure").alias("failures"), good.alias("_s"))
    return out.select(*by, "requests", "failures", F.array_min("_s").alias("seconds_min"), F.when(F.size("_s") > 0, index_percentile(F.col("_s"), 0.5)).alias("seconds_median"), F.array_max("_s").alias("seconds_max"))


def consecutive_failures(runs: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """runs whose predecessor failed as they did."""
    before = F.lag("hard_failure").over(Window.partitionBy(*by).orderBy(order))
    return runs.withColumn("_before", before).filter(F.col("hard_failure") & F.coalesce("_before", F.lit(False))).drop("_before")


def leakage(records: DataFrame, key: str, label: str, fields: list[str]) -> DataFrame:
    """Fields of which every value that recurs stands for one label only: (field, recurring values)."""
    part = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = records.select(F.col(label).alias("label"), part.alias("p")).select("label", "p.*").filter("value IS NOT NULL")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).filter("n >= 2")
    return counts.groupBy("field").agg(F.count("*").alias("recurring"), F.bool_and(F.col("labels") == 1).alias("leaks")).filter("leaks").drop("leaks")
