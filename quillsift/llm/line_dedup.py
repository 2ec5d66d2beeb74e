"""Line dedup: a segment-partition edit join over the lines of all documents, in DataFrame functions only.

A line with a word is removed if the same line stands earlier (by doc_id, then row content, then place), or if a line
within edits(n) edits first stands earlier than it does, n being the shorter line's length; for the latter both lines have
MIN_CHARS characters or more. Lines without a word stay. A document keeps its other lines in order.

Threshold. edits(n) is one edit in PER characters, 1 at least and MOST at most; `per` and `most` are parameters.
Segments. A line of length l is cut into edits(l) + 1 segments of about equal length. Of two lines within as many edits, one
segment of the shorter line is whole in the other, shifted by no more than the edits on its left (and what the lengths leave
to those on its right). So a line is indexed by its segments, and probes the grid of each length that a line it is near to may
have with its substrings at these shifts: a fixed number of keys for each threshold (4, 12, 26 for 1, 2, 3 edits).
Candidates. A key that two lines share gives one pair; texts are fetched once, for lines that share a key. In a larger group the first line is held
against the others, which settles those near it; what is left are guests, which visit all earlier lines of their group in
blocks of BLOCK. A group's lines differ in length by MOST at most, as the key holds the grid's length. Before texts are
compared, parities of character pairs and of characters drop pairs that are provably too far apart. No near pair is left out.
Verification. What a pair's lines share at either end is cut off; a banded bit-parallel edit distance decides over the rest.

Defined results: null texts have no lines and stay null; identical rows are told apart, the second loses its lines; an
empty table gives an empty result; extra columns, also such with clashing names, are kept by dedup_documents and ignored by
the query; rows with a null doc_id count as the first ones; a line of any length costs its length times a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import NOT_SPACE, let, packed, release, row_key, stage, staged

PER, MOST = 40, 2
MIN_CHARS = 20
BLOCK = 256


def edits(n: Column, per: int = PER, most: int = MOST) -> Column:
    """Edits that two lines may differ by, the shorter one having n characters."""
    return F.least(F.greatest(F.floor(n / per), F.lit(1)), F.lit(most)).cast("int")


def has_word(line: Column) -> Column:
    """Whether a line has a character that is not a separator."""
    return F.rlike(line, F.lit(NOT_SPACE))


def _probes(most: int) -> list[list[dict[str, int]]]:
    """For each threshold k from 1: (k, how much longer than the grid's line the own one is, segment, shift)."""
    return [
        [{"k": k, "longer": longer, "i": i, "shift": shift} for longer in range(k + 1) for i in range(k + 1) for shift in range(max(-i, longer - (k - i)), min(i, longer + (k - i)) + 1)]
        for k in range(1, most + 1)
    ]


def segment_keys(line: Column, n: Column, per: int = PER, most: int = MOST) -> Column:
    """Hashes of a line's segments and probes; lines within their edits share one at least."""
    probes = [F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in p.items()]) for p in of_k]) for of_k in _probes(most)]
    fits = F.filter(F.concat(*probes), lambda p: (n - p["longer"] >= MIN_CHARS) & (edits(n - p["longer"], per, most) == p["k"]))
    # but near a class's border all grids have one threshold
    plain = (edits(n - most, per, most) == edits(n, per, most)) & (n - most >= MIN_CHARS)
    some = F.when(plain, F.element_at(F.array(*probes), edits(n, per, most))).otherwise(fits)

    def keyed(wide: Column) -> Column:
        def key(p: Column) -> Column:
            grid = n - p["longer"]
            cut = lambda i: (i * grid / (p["k"] + 1)).cast("int")
            return F.xxhash64(grid, p["i"], F.substr(wide, 4 * (cut(p["i"]) + p["shift"]) + 1, 4 * (cut(p["i"] + 1) - cut(p["i"]))))

        return F.transform(some, key)

    # four bytes a character: a substring costs its own length, not that of all that stands before it
    return let(F.encode(line, "UTF-32"), keyed)


def parities(line: Column) -> Column:
    """(pairs, ones): 64 bits each, the parities of the numbers of character pairs and of characters that hash to them.

    An edit takes and adds four pairs and two characters at most.
    """
    flip = lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    follow = lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda p, q: F.struct(F.xxhash64(p, q).alias("p"), F.ascii(p).alias("o")))
    start = F.struct(F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("ones"))
    return F.aggregate(let(F.split(line, ""), follow), start, lambda x, h: F.struct(flip(x["pairs"], h["p"]).alias("pairs"), flip(x["ones"], h["o"]).alias("ones")))


def _alike(p: str, q: str, per: int, most: int) -> Column:
    """False only if parities or lengths (of the columns p and q, structs with bits and n) prove that two lines are too far apart."""
    apart = lambda bits: F.bit_count(F.col(f"{p}.bits.{bits}").bitwiseXOR(F.col(f"{q}.bits.{bits}")))
    k = edits(F.least(f"{p}.n", f"{q}.n"), per, most)
    return (apart("pairs") <= 4 * k) & (apart("ones") <= 2 * k) & (F.abs(F.col(f"{p}.n") - F.col(f"{q}.n")) <= k)


def banded_distance(a: Column, b: Column, most: int = MOST) -> Column:
    """Edit distance of the character arrays a and b where it is `most` or less, else more than `most`; a is not shorter.

    The 2 * most + 1 cells around the diagonal are bits of one word. Each character of b moves the word one cell down:
    `vp` and `vn` mark cells above which the distance rises or falls, and the lowest diagonal gives the distance.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    la, lb = F.size(a), F.size(b)
    word = lambda x: x.bitwiseAND(F.lit(full).cast("long"))
    inverse = lambda x: word(F.bitwise_not(x))
    bit = lambda x, at: F.call_function("shiftright", x, at if isinstance(at, Column) else F.lit(at)).bitwiseAND(F.lit(1).cast("long"))

    def step(state: Column, i: Column) -> Column:
        vp, vn, d = state["vp"], state["vn"], state["d"]
        own = F.get(b, i)
        # beyond either end there is null, which matches nothing
        match = sum((F.when(F.get(a, i + (t - most)) == own, F.lit(1 << t)).otherwise(F.lit(0)) for t in range(width)), F.lit(0)).cast("long")

        def moved(x: Column) -> Column:
            d0 = word((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)

            def rest(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                # below the diagonal's end the distance follows the last row
                at = F.greatest(F.lit(width - 2) - (i - (la - most)), F.lit(0))
                grown = F.when(i < la - most, 1 - bit(d0, width - 1)).otherwise(bit(hp, at) - bit(hn, at))
                return F.struct(hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (d + grown).alias("d"))

            return let(d0, rest)

        return let(match, moved)

    start = F.struct(F.lit((full >> most << most) & full).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(la, F.lit(most)).cast("long").alias("d"))
    run = F.aggregate(F.sequence(F.lit(0), lb - 1), start, step, lambda s: s["d"])
    return F.when(la - lb > most, F.lit(most + 1).cast("long")).when(lb == 0, la.cast("long")).otherwise(run)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read instead of copying its definition."""
    return df.withColumn(name, F.explode(F.array(value)))


def near_enough(pairs: DataFrame, per: int = PER, most: int = MOST) -> DataFrame:
    """The rows of pairs (la, lb, ...: two lines, la not shorter) whose lines are within their edits."""
    own = _once(pairs, "_cut", F.struct(F.split("la", "").alias("a"), F.split("lb", "").alias("b")))
    a, b = F.col("_cut.a"), F.col("_cut.b")

    def shared(x: Column, y: Column) -> Column:
        """How many characters x and y share from their starts; x is not shorter."""
        differs = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(differs > 0, differs - 1).otherwise(F.size(x).cast("long")).cast("int")

    own = _once(own, "_p", shared(a, b))
    own = _once(own, "_s", F.least(shared(F.reverse(a), F.reverse(b)), F.size(b) - F.col("_p")))
    middle = lambda x: F.slice(x, F.col("_p") + 1, F.size(x) - F.col("_p") - F.col("_s"))
    own = _once(own, "_rest", F.struct(middle(a).alias("a"), middle(b).alias("b")))
    near = banded_distance(F.col("_rest.a"), F.col("_rest.b"), most) <= edits(F.length("lb"), per, most)
    return own.filter(near).drop("_cut", "_p", "_s", "_rest")


def occurrences(docs: DataFrame) -> DataFrame:
    """(k, doc_id, i, h, h2, n): every line with a word of (k, doc_id, text), by place, two hashes and length."""
    lines = docs.select("k", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(has_word(F.col("line")))
    return lines.select("k", "doc_id", "i", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(9), F.col("line")).alias("h2"), F.length("line").alias("n"))


def _texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, first, n, line) of the distinct lines in firsts."""
    places = firsts.groupBy("first.k").agg(F.collect_list(F.struct("h", "n", "first")).alias("wanted"))
    order = Window.partitionBy("k").orderBy("doc_id")
    once = docs.select("k", "doc_id", "text").withColumn("_r", F.row_number().over(order)).filter("_r = 1")  # identical rows share k
    texts = _once(once.select("k", "text").join(places, "k"), "s", F.split("text", "\n"))
    texts = texts.select("s", F.explode("wanted").alias("w"))
    return texts.select(F.col("w.h").alias("h"), F.col("w.first").alias("first"), F.col("w.n").alias("n"), F.get("s", F.col("w.first.i")).alias("line"))


def _later(pairs: DataFrame, lines: DataFrame, per: int, most: int) -> DataFrame:
    """(h): of each near pair (x, y) the line that first stands later."""
    side = lambda p: lines.select(F.col("h").alias(p), F.col("line").alias(f"l{p}"), F.col("own").alias(f"o{p}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(_alike("ox", "oy", per, most))
    longer = F.col("ox.n") >= F.col("oy.n")
    later = F.when(F.col("ox.first") < F.col("oy.first"), F.col("y")).otherwise(F.col("x"))
    both = both.select(later.alias("h"), F.when(longer, F.col("lx")).otherwise(F.col("ly")).alias("la"), F.when(longer, F.col("ly")).otherwise(F.col("lx")).alias("lb"))
    return near_enough(both, per, most).select("h").distinct()


def near_lines(docs: DataFrame, firsts: DataFrame, per: int = PER, most: int = MOST) -> DataFrame:
    """(h) of the lines of docs (k, doc_id, text) that have an earlier one within their edits; firsts has each line's first place."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("n", F.length("line")).filter((F.col("n") >= MIN_CHARS) & has_word(F.col("line")))
    keyed = lines.select(F.xxhash64("line").alias("h"), F.explode(segment_keys(F.col("line"), F.col("n"), per, most)).alias("key"))
    # rows of a repeated line count each, so that a pair is told apart only where neither line is repeated
    shared = keyed.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.count("*").alias("c")).filter("x < y")
    shared = stage(shared, "lines-keys")
    release(spark)
    two = shared.filter("c = 2").select("x", "y").distinct()
    # the keys have no bound, so they are never broadcast; a merge join's hot keys can be split
    held = stage(keyed.join(shared.filter("c > 2").select("key").hint("merge"), "key").select("key", "h").distinct(), "lines-groups")
    release(spark)
    some = two.select(F.explode(F.array("x", "y")).alias("h")).unionByName(held.select("h")).distinct()
    own = F.struct("first", "n", parities(F.col("line")).alias("bits"))
    known = stage(_texts(docs, firsts.join(some.hint("merge"), "h")).select("h", own.alias("own"), "line"), "lines-candidates")
    release(spark)
    held = stage(held.join(known.select("h", "own"), "h"), "lines-held")
    lead = held.groupBy("key").agg(F.min(F.struct("own.first", "h", "own")).alias("lead"), F.count("*").alias("m"))
    lead = stage(lead.select("key", F.col("lead.h").alias("x"), F.col("lead.own").alias("ox"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "lines-leads")
    led = held.join(lead, "key").filter((F.col("h") != F.col("x")) & _alike("own", "ox", per, most)).select("x", F.col("h").alias("y"))
    settled = stage(_later(stage(two.unionByName(led).distinct(), "lines-pairs"), known, per, most), "lines-settled")
    # the others of a group are not near to its first line: they visit all that stand before them
    others = held.join(lead.select("key", "x", "blocks"), "key").filter("h <> x")
    guests = others.join(settled, "h", "left_anti").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", F.col("h").alias("y"), F.col("own").alias("oy"))
    hosts = others.withColumn("block", F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks")).cast("int")).select("key", "block", F.col("h").alias("x"), F.col("own").alias("ox"))
    meet = [guests[c] == hosts[c] for c in ("key", "block")]
    more = guests.join(hosts, [*meet, (F.col("ox.first") < F.col("oy.first")) & _alike("ox", "oy", per, most)]).select("x", "y").distinct()
    return settled.unionByName(_later(stage(more, "lines-more"), known, per, most)).distinct()


def removed_lines(docs: DataFrame, per: int = PER, most: int = MOST) -> DataFrame:
    """(k, gone): for texts k (k, doc_id, text) the places of lines to remove; identical rows count as one here."""
    occ = stage(occurrences(docs), "lines-occurrences")
    firsts = occ.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "k", "i")).alias("first"), F.count("*").alias("c"), F.min("n").alias("n"))
    firsts = stage(firsts, "lines-first")
    again = occ.select("h", "h2", "k", "doc_id", "i").join(firsts.filter("c > 1").select("h", "h2", "first"), ["h", "h2"]).filter(~F.struct("doc_id", "k", "i").eqNullSafe(F.col("first")))
    near = staged(docs.sparkSession, "lines-near", lambda: near_lines(docs, firsts, per, most))
    release(docs.sparkSession)
    gone = again.select("k", "i").unionByName(occ.join(near, "h").select("k", "i"))
    return gone.groupBy("k").agg(F.collect_set("i").alias("gone"))


def dedup(docs: DataFrame, per: int = PER, most: int = MOST) -> DataFrame:
    """docs (doc_id, text, ...) with _lines (lines with a word), _removed (how many of them go) and _kept (the text left)."""
    keyed = docs.withColumn("_k", row_key("doc_id", "text"))
    gone = staged(docs.sparkSession, "lines-gone", lambda: removed_lines(keyed.select(F.col("_k").alias("k"), "doc_id", "text"), per, most))
    same = Window.partitionBy("_k").orderBy("doc_id")
    joined = keyed.join(gone.withColumnRenamed("k", "_g"), F.col("_k") == F.col("_g"), "left").withColumn("_copy", F.row_number().over(same))
    split = _once(joined.withColumn("_s", F.split("text", "\n")), "_lines_", F.col("_s"))
    lost = F.coalesce("gone", F.array().cast("array<int>"))
    worded = F.filter("_lines_", has_word)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines_") - 1), lost)
    kept = F.when(F.col("_copy") == 1, F.transform(stay, lambda i: F.get("_lines_", i))).otherwise(F.filter("_lines_", lambda x: ~has_word(x)))
    out = split.withColumn("_lines", F.coalesce(F.size(worded), F.lit(0)).cast("long"))
    removed = F.when(F.col("_copy") == 1, F.size(lost)).otherwise(F.col("_lines")).cast("long")
    out = out.withColumn("_removed", removed).withColumn("_kept", F.when(removed == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop("_k", "_g", "gone", "_copy", "_s", "_lines_")


def dedup_documents(docs: DataFrame, per: int = PER, most: int = MOST) -> DataFrame:
    """docs with the kept text; documents of which no line with a word is left are dropped, those that had none stay."""
    out = dedup(packed(docs, "doc_id", "text"), per, most).filter("_lines = 0 OR _removed < _lines")
    row = F.col("_row").withField("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_kept").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """Per document: lines with a word, how many of them go, and the MD5 of the text that is left."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.md5(F.coalesce("_kept", F.lit("")).cast("binary")).alias("kept_md5"))


#: DuckDB counts edits of bytes: the 26 letters beyond ASCII that it can tell apart, more than the tables have, become control characters.
ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS word FROM l),
f AS (SELECT line, min((doc_id, i)) AS first, length(line) AS n FROM w WHERE word GROUP BY line),
p AS (SELECT a.line AS x, b.line AS y, b.first > a.first AS y_later, least(greatest(a.n // 40, 1), 2) AS k, a.n // 4 AS q
  FROM f AS a JOIN f AS b ON b.n BETWEEN a.n AND a.n + 2 AND (a.n < b.n OR a.line < b.line)
  WHERE a.n >= 20 AND (contains(b.line, a.line[1:a.n // 4]) OR contains(b.line, a.line[a.n // 4 + 1:a.n // 2]) OR contains(b.line, a.line[a.n // 2 + 1:a.n // 2 + a.n // 4]) OR contains(b.line, a.line[a.n // 2 + a.n // 4 + 1:]))),
z AS (SELECT coalesce(string_agg(DISTINCT c, ''), '') AS wide FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM documents)),
o AS (SELECT string_agg(chr(i::INTEGER), '') AS bytes FROM range(1, 32) AS r(i) WHERE i NOT BETWEEN 9 AND 13),
e AS (SELECT DISTINCT CASE WHEN y_later THEN y ELSE x END AS line FROM p, z, o
  WHERE abs(length(x) - length(y)) <= k AND levenshtein(translate(x, wide, bytes), translate(y, wide, bytes)) <= k),
g AS (SELECT w.*, word AND (f.first <> (w.doc_id, w.i) OR e.line IS NOT NULL) AS gone FROM w LEFT JOIN f ON f.line = w.line AND word LEFT JOIN e ON e.line = w.line)
SELECT d.doc_id, coalesce(count(*) FILTER (WHERE word), 0)::BIGINT AS n_lines, coalesce(count(*) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
  md5(coalesce(string_agg(g.line, chr(10) ORDER BY g.i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_md5
FROM documents AS d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""
