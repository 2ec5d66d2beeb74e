"""Anonymisation of a mailbox owner's address and name, salutation names and file names; and the check that none is left."""

from __future__ import annotations

import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.corpus import alias_map, file_alias

# ---- fixed values

OWN_ADDRESS, OWN_NAME = "user@example.test", "Ad Soyad 0"
OWN_URL = "https://redacted.example.test/own-identity-in-url"
GENERIC = "Customer|User|Friend|Friends|Reader|Client|Member|Shopper|Beloved|Beneficiary|Recipient|There|Community|Owner|Developers|Notice|Paid|Valued|Dear|My|Important"
NAME = rf"(?!(?:{GENERIC})\b)[A-ZÇĞİÖŞÜ][a-zçğıöşü']+(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü']+){{0,2}}"
SALUTATION = rf"\b(Sayın|Dear|Hi|Hello|Merhaba)\s+({NAME})\s*[,:]"

# ---- end of fixed values


def redact_own(text: Column, address: str, names: list[str]) -> Column:
    """text with the owner's address and name variants replaced, whatever their case."""
    out = text
    if address:
        out = F.regexp_replace(out, "(?iu)" + re.escape(address), OWN_ADDRESS)
    if names:
        out = F.regexp_replace(out, r"(?iuU)\b(?:" + "|".join(map(re.escape, names)) + r")\b", OWN_NAME)
    return out


def redact_urls(urls: Column, address: str, names: list[str]) -> Column:
    """URLs that hold the owner's identity, percent-encoded up to three times, as one placeholder. Arrow UDF: unquote leaves bad escapes."""
    known = re.compile("|".join(map(re.escape, [x for x in [address, *names] if x])) or r"(?!)", re.IGNORECASE)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        def one(url: str) -> str:
            plain = url
            for _ in range(3):
                plain = urllib.parse.unquote(plain)
            return OWN_URL if known.search(plain) else url

        return lists.map(lambda us: None if us is None else [one(u) if u is not None else None for u in us])

    return run(urls)


def salutation_names(text: Column) -> Column:
    """Names that salutations hold, in order."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SALUTATION), F.lit(2))


def alias_salutations(df: DataFrame, key: str, text: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """df with each salutation's name in text as `Ad Soyad N`, N by first occurrence in (order, place)."""
    pieces = df.select(key, order, text, F.posexplode_outer(salutation_names(F.col(text))).alias("_i", "real"))
    seen = pieces.filter("real IS NOT NULL").select("real", F.struct(order, "_i").alias("ord"))
    named = pieces.filter("real IS NOT NULL").join(alias_map(seen, known), "real")
    swaps = named.groupBy(key).agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("_i", "real", "alias_no")))).alias("_swaps"))

    def replaced(t: Column, swap: Column) -> Column:
        # the name is quoted: only the salutation that holds it changes
        pattern = F.concat(F.lit(r"(?U)\b(Sayın|Dear|Hi|Hello|Merhaba)\s+\Q"), swap["real"], F.lit(r"\E\s*([,:])"))
        return F.regexp_replace(t, pattern, F.concat(F.lit("$1 Ad Soyad "), swap["alias_no"].cast("string"), F.lit("$2")))

    none = F.array().cast("array<struct<_i:int,real:string,alias_no:bigint>>")
    return df.join(swaps, key, "left").withColumn(text, F.aggregate(F.coalesce("_swaps", none), F.col(text), replaced)).drop("_swaps")


def alias_files(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(real, ord) to (real, alias): file-0000.ext by first occurrence."""
    return alias_map(files, known).select("real", "alias_no", file_alias(F.col("real"), F.col("alias_no")).alias("alias"))


def leaks(df: DataFrame, key: str, address: str, names: list[str]) -> DataFrame:
    """(key, issue): serialised rows that still hold the owner's address, name, or a salutation's name."""
    blob = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    checks = [
        F.when(F.contains(F.lower(blob), F.lit(address.lower())), "own_address") if address else F.lit(None).cast("string"),
        F.when(blob.rlike(r"(?iuU)\b(?:" + "|".join(map(re.escape, names)) + r")\b"), "own_name") if names else F.lit(None).cast("string"),
        F.when(blob.rlike("(?U)" + SALUTATION.replace(r"({NAME})", NAME).replace(r"(?!(?:", r"(?!Ad Soyad)(?!(?:")), "salutation_name"),
    ]
    return df.select(key, F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("issue"))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
