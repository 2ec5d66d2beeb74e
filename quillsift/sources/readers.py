"""Sources: message files, mailboxes, JSON lines of facts, pasted text, labels in Markdown, YAML blocks."""

from __future__ import annotations

import json
import mailbox
import os
import tempfile
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillsift.schema import EMAIL_FACTS


def read_eml(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(path, modificationTime, length, content) of message files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


class _Mailbox(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _MailboxReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Mailbox(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        label = "sent" if "sent" in os.path.basename(partition.path).lower() else "inbox"
        for i, key in enumerate((box := mailbox.mbox(partition.path, create=False)).iterkeys()):
            yield partition.path, label, i, box.get_bytes(key)


class MboxSource(DataSource):
    """spark.read.format("mbox").load(path): one partition per mailbox file; for files that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "mailbox string, label string, seq int, content binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _MailboxReader([p for p in self.options["path"].split(",") if p])


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailboxes in any store that Spark reads: each file is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def split(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                with tempfile.NamedTemporaryFile() as f:  # mailbox reads files only
                    f.write(c)
                    f.flush()
                    box = mailbox.mbox(f.name, create=False)
                    label = "sent" if "sent" in os.path.basename(p).lower() else "inbox"
                    for i, key in enumerate(box.iterkeys()):
                        yield pd.DataFrame({"mailbox": [p], "label": [label], "seq": [i], "content": [box.get_bytes(key)]})

    return files.mapInPandas(split, "mailbox string, label string, seq int, content binary")


def read_facts(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Facts from JSON lines by their schema (and extra columns, DDL); blank lines are skipped, bad ones fail the read."""
    schema = EMAIL_FACTS + (f", {extra}" if extra else "")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unknown_fields(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(field): names at the top level of JSON lines that the schema does not know."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.explode(F.json_object_keys("value")).alias("field")).distinct().filter(~F.col("field").isin(known))


def pasted(spark: SparkSession, *texts: str) -> DataFrame:
    """(input_id, content) of pasted messages."""
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "input_id int, content binary")


def read_markdown_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) of worksheets: blocks that name a path in back quotes and hold a `label: value` line."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"(?m)^##+ ")).alias("block"))
    return blocks.select(
        F.nullif(F.regexp_extract("block", r"`([^`]+\.eml)`", 1), F.lit("")).alias("path"),
        F.nullif(F.lower(F.regexp_extract("block", r"(?im)^[^\w\n:]*label[^\w\n:]*:[^\w\n]*([a-z_]+)", 1)), F.lit("")).alias("label"),
    ).filter("path IS NOT NULL")


def read_yaml_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(source, doc) of the ```yaml blocks of Markdown files, each as JSON; blocks that do not parse have a null doc."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)```yaml\n(.*?)```"), F.lit(1))).alias("block"))

    @F.pandas_udf("string")
    def parse(blocks: pd.Series) -> pd.Series:
        def one(b: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(b), ensure_ascii=False, default=str)
            except yaml.YAMLError:
                return None

        return blocks.map(one)

    return whole.select("source", parse("block").alias("doc"))
