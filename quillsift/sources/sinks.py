"""Sinks: JSON lines, HTML reports, Markdown worksheets."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.session import ship


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the committer makes the write atomic."""
    df.write.mode("append" if append else "errorifexists").json(path)


def _page(r: dict) -> str:
    e = lambda x: html.escape(str(x if x is not None else ""), quote=True)
    findings = "".join(f"<li><b>{e(f['baslik'])}</b>: {e(f['aciklama'])}</li>" for f in r["teknik_bulgular"])
    signs = "".join(f"<li>{e(x)}</li>" for x in r["phishing_gostergeleri"])
    return (
        f"<!doctype html><html lang=\"tr\"><head><meta charset=\"utf-8\"><title>{e(r['risk_seviyesi'])}</title></head><body>"
        f"<h1>{e(r['risk_seviyesi'])}</h1><p>{e(r['sonuc_ve_gerekce'])}</p><p>{e(r['genel_degerlendirme'])}</p>"
        f"<h2>Teknik bulgular</h2><ul>{findings}</ul><h2>Göstergeler</h2><ul>{signs}</ul><p>{e(r['onerilen_aksiyon'])}</p></body></html>"
    )


def render_html(report: Column) -> Column:
    """A report struct as an HTML page; all values are escaped."""
    ship()

    @F.pandas_udf("string")
    def run(reports: pd.DataFrame) -> pd.Series:
        return pd.Series([_page(r) for r in reports.to_dict("records")])

    return run(report)


def worksheet(df: DataFrame, key: str, lines: list[Column], blind: bool = True) -> DataFrame:
    """(key, block): a Markdown block to label; with blind, only the lines given, no verdict."""
    head = [F.concat(F.lit("## `"), F.col(key), F.lit("`")), *lines]
    return df.select(key, F.concat_ws("\n", *head, F.lit("label: "), F.lit("")).alias("block"))


def filled_labels(blocks: DataFrame) -> DataFrame:
    """One row: how many blocks hold a label; a worksheet with any must not be overwritten."""
    return blocks.agg(F.count_if(F.col("block").rlike(r"(?im)^label:[ \t]*\S")).alias("filled"))


def signal_digest(urls: Column) -> Column:
    """The first five addresses, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(urls, 1, 5), lambda u: F.concat(F.lit("- "), u["url"])), "\n")
    more = F.size(urls) - 5
    return F.when(more > 0, F.concat(shown, F.format_string("\nand %d more", more))).otherwise(shown)
