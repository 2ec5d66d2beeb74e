"""Every registered query with SQL against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from quillsift.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, columns = plain(catalog.queries()[name](spark, str(DATA)).toPandas())
    want, names = plain(duck.execute(catalog.oracle_sql()[name]).df())
    assert columns == names
    if got != want:  # integers that hold nulls print as floats on one side
        norm = lambda rows: [tuple(v[:-2] if v.endswith(".0") else v for v in r) for r in rows]
        assert sorted(norm(got)) == sorted(norm(want))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0


def test_every_signal_of_the_rules_is_used():
    from quillsift.operators import rules

    used = {s for s, _ in rules.v1_predicates()} | {s for group in rules.v2_predicates().values() for _, s, _ in group}
    assert set(rules.load_rules()["signals"]) <= used


def test_spam_ladder_matches_sql_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["re itauö und Ñups", "ketoñ", "éconfirm your account", "verıfy your account", "a Vİsa b", "a vısa b", "un kraKen x", "flaſh sales", "action required\rfor your account", "anti aging", "xxx ups", "ñatt @tt", None, "", "ä\nöconfirm your account"]
    ids = [i for i in range(400) if i % 12 > 8][: 4 * len(texts)]
    rows = [(i, texts[k % len(texts)], "en", "src0") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, _ = plain(catalog.queries()["spam_audit_ladder"](spark, str(tmp_path)).toPandas())
    want, _ = plain(con.execute(catalog.oracle_sql()["spam_audit_ladder"]).df())
    assert got == want


def test_spam_ladder_reads_whole_texts(spark, tmp_path):
    far = "lorem ipsum dolor " * 400
    ends = ["paypal writes", "la poste writes", "enter your pin", "slots and more", "an inheritance", "flash sale", "million euros was a deposit", "shop now", "nothing else"]
    texts = [f"{far}\n{end}\n{'tail ' * 30}" for end in ends]
    ids = [i for i in range(400) if i % 12 > 8][: 5 * len(texts)]
    spark.createDataFrame([(i, texts[k % len(texts)], "en", "src0") for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = catalog.queries()["spam_audit_ladder"](spark, str(tmp_path)).toPandas()
    got, _ = plain(out)
    want, _ = plain(con.execute(catalog.oracle_sql()["spam_audit_ladder"]).df())
    assert got == want
    assert {"paypal", "la poste"} <= set(out["brand"].dropna())
    assert {"brand_impersonation", "credential_request", "advance_fee", "spam_topic"} <= set(out["spam_reason"])


def test_every_spam_pattern_has_strings_to_look_for():
    from quillsift.operators import audit

    for pattern in [*audit.SPAM_TOPICS, audit.SCAM, *audit.CREDENTIAL, audit.BOILERPLATE, audit.MARKETING]:
        for part in audit._top_level(pattern):
            assert min(map(len, audit._needed(audit.regex_parser.parse(part)))) > 2, part
