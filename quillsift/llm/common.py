"""What the corpus operators share: staging, Arrow limits, reading documents, column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.session import ship

#: Word separators of every contract: space and \x09-\x0D (Java and RE2 character class).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_BASE = "quillsift.stage.base"


#: Paths staged in the open scopes, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir, or one of our own where it is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_BASE, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.conf.set(_BASE, base)
    return base.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/quillsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    out, path = _written(df, name)
    for scope in _SCOPES.get()[-1:]:
        scope.append(path)
    return out


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a staged table; what make staged on its way is deleted once that is written."""
    own: list[str] = []
    mark = _SCOPES.set((*_SCOPES.get(), own))
    try:
        out, path = _written(make(), name)
    finally:
        _SCOPES.reset(mark)
        for p in own:
            _delete(spark, p)
    for scope in _SCOPES.get()[-1:]:
        scope.append(path)
    return out


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left join right, never by a broadcast: for tables that grow with the input, whose files tell Spark less than they take in memory."""
    return left.join(right.hint("merge"), on, how)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more: Spark deletes them once the driver has collected its garbage."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables; results that were not written yet can't be read after it."""
    _delete(spark, f"{stage_dir(spark)}/quillsift")


def arrow_batches(spark: SparkSession, records: int = 512) -> None:
    """Bound what one Arrow batch holds, so that long texts do not gather in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns of docs in the struct _row, and the named ones beside it: no helper column can clash with docs' own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", *[F.col("_row").getField(n).alias(n) for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable, not a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's content; identical rows share it, and then share their outcome."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
