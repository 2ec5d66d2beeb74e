"""Labelled rows for fitting: a bounded sample that never touches held-out documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import held_out

_GRAIN = 1 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label, part): about `most` labelled rows at most, picked by a hash of doc_id.

    Rows whose crc32 remainder is 0 are left out; part is the remainder, 1 to 4. A doc_id labelled twice takes the
    larger label; null labels and null ids are dropped.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_GRAIN)) < int(_GRAIN * most / n))
    part = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int")
    # the picked labels are bounded by `most`, so sending them to all tasks spares a shuffle of the texts
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").withColumn("part", part)
