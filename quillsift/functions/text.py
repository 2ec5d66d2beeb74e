"""Body and text functions as column expressions. Patterns that follow Unicode use (?iuU); offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L

BODY_CHARS = 2000
CONTEXT_CHARS = 40
_HEADERS = r"(?im)^(" + "|".join(L.HEADER_NAMES) + r")\s*:"


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode knows it."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def finds(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere, case-insensitive and Unicode-aware; null texts don't."""
    return F.coalesce(text.rlike("(?iuU)" + pattern), F.lit(False))


def distinct_headers(text: Column) -> Column:
    """Distinct lower-cased names of known header lines in the first 4000 characters."""
    found = F.regexp_extract_all(F.substring(text, 1, 4000), F.lit(_HEADERS), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, F.lower)), F.array().cast("array<string>"))


def looks_like_raw_email(text: Column) -> Column:
    """Three distinct known headers or more."""
    return F.size(distinct_headers(text)) >= 3


def canonical_body(text: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def strip_gateway_banner(text: Column) -> Column:
    """Text up to a mail gateway's banner, stripped; unchanged without one."""
    pattern = "(?iuUs)" + L.GATEWAY_BANNER
    return F.when(text.rlike(pattern), strip(F.regexp_replace(text, pattern, ""))).otherwise(text)


def detect_language(text: Column) -> Column:
    """tr, en or other, from the first 2000 characters."""
    head = F.substring(text, 1, BODY_CHARS)
    words = F.array_distinct(F.regexp_extract_all(F.lower(head), F.lit("[a-zçğıöşü]+"), F.lit(0)))
    known = F.size(F.array_intersect(words, F.array(*map(F.lit, L.TURKISH_WORDS))))
    return F.when(head.rlike("[ışğİŞĞ]") | (known >= 2), "tr").when(head.rlike("[a-zA-Z]"), "en").otherwise("other")


def is_turkish(text: Column) -> Column:
    """The looser corpus check: letters of Turkish, or two of its frequent words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zçğıöşü]+"), F.lit(0)))
    return text.rlike("[çğıöşüÇĞİÖŞÜ]") | (F.size(F.array_intersect(words, F.array(*map(F.lit, L.TURKISH_WORDS)))) >= 2)


def _keyword_pattern(keyword: str) -> str:
    return r"\b" + keyword + (r"\w*" if keyword in L.URGENCY_STEMS else r"\b")


_FOLD = ("İıſK", "iisk")


def _folded(text: Column) -> Column:
    """Lower case in which letters that a case-insensitive pattern takes for each other are one."""
    return F.lower(F.translate(text, *_FOLD))


def urgency_hits(text: Column, language: Column) -> Column:
    """array<struct<keyword, context>> of the language's keywords (both lists for other), first hit each, by keyword."""

    def found(folded: Column) -> Column:
        hits = []
        for lists, keywords in ((("tr", "other"), L.URGENCY_TR), (("en", "other"), L.URGENCY_EN)):
            for k in keywords:
                pattern = _keyword_pattern(k)
                start = F.length(F.regexp_extract(text, f"(?iuUs)^(.*?){pattern}", 1))
                length = F.length(F.regexp_extract(text, f"(?iuU){pattern}", 0))
                first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
                context = strip(F.replace(F.substr(text, first + 1, start + length + CONTEXT_CHARS - first), F.lit("\n"), F.lit(" ")))
                # a plain search comes first: patterns are slow, and most texts hold no keyword
                near = language.isin(*lists) & F.contains(folded, F.lit(k.translate(str.maketrans(*_FOLD)).lower()))
                hits.append(F.when(near & finds(text, pattern), F.struct(F.lit(k).alias("keyword"), context.alias("context"))))
        return F.array_sort(F.filter(F.array(*hits), lambda h: h.isNotNull()))

    return F.element_at(F.transform(F.array(_folded(text)), found), 1)


def urgency_keywords(text: Column, language: Column) -> Column:
    """Only the keywords of urgency_hits, comma-joined."""
    return F.array_join(F.transform(urgency_hits(text, language), lambda h: h["keyword"]), ",")


def claims_attachment(text: Column, has_attachments: Column) -> Column:
    """The text names an attachment where there is none."""
    return ~has_attachments & finds(text, L.ATTACHMENT_CLAIM)


def advance_fee(text: Column) -> Column:
    """Language of advance-fee fraud."""
    return finds(text, L.ADVANCE_FEE)


def fake_reward(text: Column) -> Column:
    """Language of false rewards."""
    return finds(text, L.FAKE_REWARD)


def image_only(has_image: Column, text: Column) -> Column:
    """Images and fewer than 20 characters of text."""
    return has_image & (F.length(strip(text)) < 20)


def usable_body(text: Column) -> Column:
    """30 characters or more without ends, and no token of over 60."""
    return (F.length(strip(text)) >= 30) & ~F.exists(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 60)


def mask_indicators(text: Column) -> Column:
    """URLs, then addresses, then IPv4 addresses, as placeholders."""
    out = F.regexp_replace(text, r"https?://\S+", "[URL]")
    out = F.regexp_replace(out, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]")
    return F.regexp_replace(out, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[IP]")


def year_month(header: Column) -> Column:
    """yyyy-Mon of a raw date header: the first year 2015 to 2030 and the first month in calendar order; unknown without a year."""
    first = lambda names: F.get(F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(header, x)), F.lit(0))
    year, month = first([str(y) for y in range(2015, 2031)]), first(L.MONTHS)
    return F.when(year.isNull(), "unknown").otherwise(F.concat_ws("-", year, month))


def normalize_homoglyphs(text: Column) -> Column:
    """Lower case with look-alike characters made one."""
    return F.translate(F.lower(text), "l10534@", "iioseaa")
