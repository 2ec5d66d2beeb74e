"""Quality rules: one threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the row's own text: no shuffle, no user function. Null texts count as
empty. Repeated rows, extra columns and an empty table pass through unchanged in number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import SPACES, let, packed

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au ce dans de des du elle en est et il la le les mais ne par pas pour que qui se sur un une "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "con como del el es las lo los más no o para por su una y"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: (measure, least, most, fewest words for the rule to speak); null: no bound.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0, 0),
    ("symbols_per_word", None, 0.25, 0),
    ("exclamations_per_word", None, 0.5, 0),
    ("upper_share", None, 0.45, 0),
    ("duplicate_line_share", None, 0.5, 0),
    ("stop_word_share", 0.01, None, 50),
)


def _removed(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the array holds twice or more.

    Windows are 64-bit hashes; most arrays have no equal ones and stop at a count of distinct values. Else the hashes
    are sorted with their positions, equal neighbours give the repeated positions, and the gaps between these give
    the number of words covered: n log n for any text.
    """

    def covered(windows: Column) -> Column:
        def positions(ranked: Column) -> Column:
            at = lambda i: F.get(ranked, i)["h"]
            same = lambda i: (at(i) == at(i - 1)) | (at(i) == at(i + 1))
            hits = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: F.coalesce(same(i), at(i) == at(i + 1), at(i) == at(i - 1), F.lit(False)))
            return F.array_sort(F.transform(hits, lambda i: F.get(ranked, i)["i"]))

        def gaps(found: Column) -> Column:
            step = lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get(found, i + 1) - F.get(found, i), F.lit(WINDOW)))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.lit(0).cast("long"), lambda n, i: n + step(i))

        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ranked, lambda r: let(positions(r), gaps)))

    def windows(hashes: Column) -> Column:
        parts = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), parts)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), covered)))


def measures(text: Column) -> Column:
    """A struct of all counts of a text; the word and line arrays are made once."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")

    def counts(parts: Column) -> Column:
        w, x = parts["w"], parts["x"]
        stop = F.filter(w, lambda one: F.lower(F.rtrim(one, F.lit(".,;:!?"))).isin(STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            _removed(body, SYMBOLS).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
            (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            _removed(body, "!").cast("long").alias("n_exclamations"),
        )

    return let(F.struct(words.alias("w"), lines.alias("x")), counts)


def verdict(m: Column) -> tuple[Column, Column]:
    """(base_failed, kept) from the struct of measures."""
    share = lambda a, b: m[a] / F.greatest(m[b], F.lit(1))
    values = {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "exclamations_per_word": share("n_exclamations", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "stop_word_share": share("n_stop_words", "n_words"),
    }
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    rules = []
    for name, least, most, speaks in THRESHOLDS:
        if least is not None:
            rules.append((values[name] >= least) | (m["n_words"] < speaks))
        if most is not None:
            rules.append((values[name] <= most) | (m["n_words"] < speaks))
    return base, ~base & reduce(lambda a, b: a & b, rules)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column `_quality`: the measures, base_failed and kept.

    The counts of a text are evaluated once, in one projection; downstream columns only read the struct.
    """
    measured = docs.withColumn("_m", measures(F.col(text)))
    # explode of one element keeps the optimizer from copying the measures into every column that reads them
    once = measured.withColumn("_m", F.explode(F.array("_m")))
    base, kept = verdict(F.col("_m"))
    return once.withColumn("_quality", F.struct("_m.*", base.alias("base_failed"), kept.alias("kept"))).drop("_m")


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    return quality_rules(packed(docs, text), text).filter("_quality.kept").select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    q = F.col("_quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", *[q[n].alias(n) for n in names])


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
v AS (SELECT r, i, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS e, lead(w, 4) OVER o AS f FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, b, c, e, f) AS n FROM v WHERE f IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, range(5) AS g(j) WHERE n > 1 GROUP BY r),
ws AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
  count(*) FILTER (WHERE lower(rtrim(w, '.,;:!?')) IN ({_STOP})) AS n_stop FROM w GROUP BY r),
x AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM x WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop,
  length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_ex
  FROM d LEFT JOIN ws USING (r) LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 14 AND n_symbols / greatest(n_words, 1) <= 0.25
  AND n_ex / greatest(n_words, 1) <= 0.5 AND n_upper / greatest(word_chars, 1) <= 0.45
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND (n_words < 50 OR n_stop / greatest(n_words, 1) >= 0.01) AS kept
FROM b
"""
