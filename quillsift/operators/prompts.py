"""Texts for model calls, as string projections: signal maps, blocks of facts, chat messages. No body, subject or query string goes into a narrative prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.urls import strip_query


def nonempty_signals(columns: list[str]) -> Column:
    """map of signals without null, false, 0 and empty entries; values as strings."""
    every = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return F.map_filter(every, lambda k, v: v.isNotNull() & ~v.isin("false", "0", "", "[]"))


def yes_no(flag: Column) -> Column:
    """evet, hayır or bilinmiyor."""
    return F.when(flag, "evet").when(~flag, "hayır").otherwise("bilinmiyor")


def url_block(urls: Column, bare: bool = True) -> Column:
    """A line per URL with its marks; bare leaves queries and fragments out."""

    def line(u: Column) -> Column:
        marks = F.array_join(F.filter(F.array(*[F.when(u[f], F.lit(name)) for f, name in (("text_href_mismatch", "mismatch"), ("is_ip_based", "ip"), ("is_shortener", "shortener"), ("has_punycode", "punycode"), ("redirect_param", "redirect"))]), lambda m: m.isNotNull()), ",")
        return F.concat(F.lit("- "), strip_query(u["url"]) if bare else u["url"], F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""))

    return F.array_join(F.transform(urls, line), "\n")


def attachment_block(attachments: Column) -> Column:
    """A line per attachment: name, type and what is odd about it."""
    odd = lambda a: F.array_join(F.filter(F.array(*[F.when(a[f], F.lit(f)) for f in ("risky_type", "double_extension", "is_archive", "extension_mismatch")]), lambda m: m.isNotNull()), ",")
    return F.array_join(F.transform(attachments, lambda a: F.concat(F.lit("- "), a["filename"], F.lit(" ("), F.coalesce(a["mime_type"], F.lit("?")), F.lit(")"), F.when(odd(a) != "", F.concat(F.lit(" ["), odd(a), F.lit("]"))).otherwise(""))), "\n")


def urgency_block(hits: Column) -> Column:
    """A line per urgency keyword with its context."""
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("- "), h["keyword"], F.lit(": "), h["context"])), "\n")


def messages(system: Column, prompt: Column, examples: list[tuple[str, str]] | None = None) -> Column:
    """Chat messages: system, pairs of examples, then the prompt."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    shots = [m for ask, answer in examples or [] for m in (say("user", F.lit(ask)), say("assistant", F.lit(answer)))]
    return F.array(say("system", system), *shots, say("user", prompt))


def narrative_prompt(report: Column, evidence: Column) -> Column:
    """What a narrative model is told: the verdict and the rules that fired."""
    fired = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e["description"], F.lit(" ("), F.when(e["weight"] >= 0, "+").otherwise(""), e["weight"].cast("string"), F.lit(")"))), "\n")
    return F.concat(F.lit("Karar: "), report["risk_seviyesi"], F.lit("\nBulgular:\n"), fired)


def findings_prompt(body: Column, types: list[str]) -> Column:
    """What a findings model is told: the allowed types and the canonical body."""
    return F.concat(F.lit("Types: " + ", ".join(types) + "\nReturn a JSON array of findings with exact quotes.\n<body>\n"), body, F.lit("\n</body>"))
