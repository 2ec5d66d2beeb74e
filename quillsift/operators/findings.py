"""Model findings: JSON extraction, schema checks over VARIANT, grounding by exact substrings, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L

_FIELDS = ("type", "evidence", "model_confidence", "explanation")


def extract_json_array(raw: Column) -> Column:
    """The array in a model's output as VARIANT; null without one."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.lit("")))


def explode_raw(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per element: outputs' columns, pos (from 0) and item (VARIANT)."""
    items = F.expr(f"try_cast(try_parse_json(nullif(regexp_extract({raw}, '(?s)\\\\[.*\\\\]', 0), '')) AS array<variant>)")
    return outputs.select("*", F.posexplode(items).alias("pos", "item")).drop(raw)


def schema_rejection(item: str = "item") -> Column:
    """SCHEMA_INVALID, UNKNOWN_TYPE, or null for an element that is a finding."""
    kind = F.schema_of_variant(item)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    field = lambda f: F.schema_of_variant(F.try_variant_get(item, f"$.{f}", "variant"))
    text = lambda f: F.coalesce(field(f) == "STRING", F.lit(False))
    type_ = F.try_variant_get(item, "$.type", "string")
    known = text("type") & F.coalesce(type_.isin(L.FINDING_TYPES), F.lit(False))
    number = F.coalesce(field("model_confidence").rlike(r"^(DECIMAL|BIGINT|DOUBLE|FLOAT)"), F.lit(False))
    confidence = F.try_variant_get(item, "$.model_confidence", "double")
    keys = F.expr(f"map_keys(try_cast({item} AS map<string, variant>))")
    extra = F.size(F.array_except(keys, F.array(*map(F.lit, _FIELDS)))) > 0
    valid = text("evidence") & text("explanation") & number & F.coalesce(confidence.between(0, 1), F.lit(False)) & ~F.coalesce(extra, F.lit(True))
    return F.when(~is_object, "SCHEMA_INVALID").when(~known, "UNKNOWN_TYPE").when(~valid, "SCHEMA_INVALID")


def candidates(raw: DataFrame, item: str = "item") -> DataFrame:
    """raw with rejection_reason, and type, evidence, model_confidence and explanation of the accepted elements."""
    out = raw.withColumn("rejection_reason", schema_rejection(item))
    get = lambda f, t: F.when(F.col("rejection_reason").isNull(), F.try_variant_get(item, f"$.{f}", t))
    for f in _FIELDS:
        out = out.withColumn(f, get(f, "double" if f == "model_confidence" else "string"))
    return out


def grounding_reason(evidence: Column, body: Column) -> Column:
    """Why evidence does not stand in body exactly once; null if it does."""
    at = F.position(evidence, body)
    again = F.position(evidence, body, at + 1)
    blank = F.regexp_replace(evidence, r"(?U)\s+", "") == ""
    return F.when(blank, "EMPTY_EVIDENCE").when(F.length(evidence) > L.MAX_EVIDENCE, "EVIDENCE_TOO_LONG").when(at == 0, "NOT_FOUND_IN_BODY").when(again > 0, "AMBIGUOUS_EVIDENCE")


def ground(found: DataFrame, key: str, body: str = "body", pos: str = "pos") -> DataFrame:
    """Candidates with rejection_reason, start and end; among grounded ones the first of equal (type, evidence) stays."""
    reason = F.coalesce(F.col("rejection_reason"), grounding_reason(F.col("evidence"), F.col(body)))
    checked = found.withColumn("_r", reason)
    first = Window.partitionBy(key, "type", "evidence", F.col("_r").isNull()).orderBy(pos)
    checked = checked.withColumn("_n", F.row_number().over(first))
    final = F.when(F.col("_r").isNull() & (F.col("_n") > 1), "DUPLICATE_FINDING").otherwise(F.col("_r"))
    start = F.when(F.col("_r").isNull() & (F.col("_n") == 1), F.position(F.col("evidence"), F.col(body)) - 1)
    out = checked.withColumn("rejection_reason", final).withColumn("start", start.cast("int"))
    # elements that are no findings come first in a result's order
    stage = F.when(F.col("_r").isin("SCHEMA_INVALID", "UNKNOWN_TYPE"), 0).otherwise(1)
    return out.withColumn("end", (F.col("start") + F.length("evidence")).cast("int")).withColumn("stage", stage).drop("_r", "_n")


def accepted(grounded: DataFrame, key: str) -> DataFrame:
    """(key, findings): the accepted findings of each message in order."""
    f = F.struct("pos", "type", "evidence", "start", "end", "model_confidence", "explanation")
    listed = F.array_sort(F.collect_list(f))
    return grounded.filter("rejection_reason IS NULL").groupBy(key).agg(F.transform(listed, lambda x: x.dropFields("pos")).alias("findings"))
