"""Column functions as small tables of inputs and results."""

import pytest
from pyspark.sql import functions as F

from quillsift.functions import attachments as A
from quillsift.functions import text as T
from quillsift.functions import urls as U


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (U.domain_of_url, {"https://User:pw@Mail.Example.com:8080/x?y#z": "mail.example.com", "http://a_b.example/": "a_b.example", "ftp://[::1]/": "[", "nothing": None, "http://": None}),
    (U.is_ip_based, {"1.2.3.4": True, "1.2.3.4.5": False, "999.1.1.1": True, "1.2.3.4\n": False}),
    (U.has_punycode, {"xn--abc.example": True, "a.xn--b": True, "axn--b.example": False}),
    (U.has_redirect_param, {"http://a/?u=HTTP%3A//b": True, "http://a/?u=https%3a//b": False, "http://a/?u=https://b": True, "http://a/http://b": False}),
    (U.anchor_text_domain, {"Go to www.PayPal.com": "paypal.com", "paypal.com/login": "paypal.com", "plain text": None, "a.b.co.uk": "co.uk"}),
    (U.strip_query, {"http://a/b?c#d": "http://a/b", "http://a/b#d?x": "http://a/b#d", "http://a/b#d": "http://a/b"}),
    (U.domain_root, {"A.b.Example.com": "example.com", "localhost": "localhost"}),
    (A.extension_of, {"a.PDF": "pdf", "none": "", "a.tar.gz": "gz"}),
    (A.double_extension, {"invoice.pdf.exe": True, "a.exe": False, "a.longname.exe": False, "v1.0.zip": True, "a.pdf.txt": False}),
    (T.canonical_body, {"a\r\nb\rc\n": "a\nb\nc\n"}),
    (T.strip_gateway_banner, {"Hello\n EXTERNAL EMAIL WARNING\nmore": "Hello", "an external thought": "an external thought", "Selam\nHARİCİ E-POSTA BİLGİLENDİRMESİ x": "Selam", "CAUTION: This email": ""}),
    (T.detect_language, {"doğru": "tr", "ve bir": "tr", "für mehr": "en", "12 34": "other", "hello": "en"}),
    (T.usable_body, {"short": False, "a fine body that has enough text in it": True, "x" * 61 + " and some more words here": False}),
    (T.mask_indicators, {"see http://a.b/c x@y.example 10.0.0.1": "see [URL] [EMAIL] [IP]"}),
    (T.year_month, {"Mon, 3 Mar 2024 10:00": "2024-Mar", "2020": "2020", "Mar 1999": "unknown", "": "unknown"}),
    (T.normalize_homoglyphs, {"PayPaL 10": "paypai io"}),
    (T.looks_like_raw_email, {"From: a\nTo: b\nsubject : c\n": True, "From: a\nfrom: b\nTo: c": False, " From: a\nTo: b\nDate: c": False}),
    (T.advance_fee, {"the next  of kin": True, "Beneficiary": True, "kin": False}),
    (T.fake_reward, {"you’ve won": True, "Claim your tokens": True, "winner": False}),
]


@pytest.mark.parametrize(("fn", "cases"), CASES, ids=[c[0].__name__ for c in CASES])
def test_cases(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_registrable_domains(spark):
    cases = {"mail.example.co.uk": "example.co.uk", "co.uk": None, "a.b.gov.tr": "b.gov.tr", "gov.tr": None, "example.com": "example.com", "x.unknowntld": "x.unknowntld", "1.2.3.4": "1.2.3.4", "a.b.ck": "a.b.ck", "www.ck": "www.ck", "x.www.ck": "www.ck"}
    df = spark.createDataFrame([(k, k) for k in cases] + [(None, None)], "d string, e string")
    got = {r.d: r.d_root for r in U.registrable_domains(df, "d").collect()}
    assert got == cases | {None: None}
    pairs = [("a.example.com", "b.example.com", True), ("example.com", "example.org", False), (None, "a.com", False), ("co.uk", "com", True), ("com", "a.com", False)]
    df = U.registrable_domains(spark.createDataFrame([p[:2] for p in pairs], "a string, b string"), "a", "b")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", U.same_organization(F.col("a"), F.col("b"), F.col("a_root"), F.col("b_root")).alias("s")).collect()}
    assert all(got[a, b] == s for a, b, s in pairs)


def test_extension_mismatch(spark):
    cases = [("a.pdf", "255044462D", False), ("a.pdf", "4D5A90", True), ("a.exe", "4D5A", False), ("a.pdf", "00", False), ("a.txt", "4D5A", False), ("a.docx", "504B0304", False), ("a.doc", "504B0304", True), ("a.pdf", "", False), ("a.rar", "526172211A070100", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "n string, h string")
    got = [r.o for r in df.select(A.extension_mismatch(F.col("h"), F.col("n")).alias("o")).collect()]
    assert got == [c[2] for c in cases]


def test_urgency_by_language_with_context(spark):
    text = "😀 " + "x" * 60 + "\nPlease ACT NOW or it will expire\n" + "y" * 60
    df = spark.createDataFrame([(text, "en"), ("acilen ve hemen tıklayın", "tr"), ("urgent acil", "other"), ("urgent", "tr"), ("Üyeliğiniz İPTAL EDİLECEK, ACıL", "tr")], "t string, l string")
    got = [r.o for r in df.select(T.urgency_hits(F.col("t"), F.col("l")).alias("o")).collect()]
    assert [h.keyword for h in got[0]] == ["act now", "expire"]
    at = text.index("ACT")
    assert got[0][0].context == text[at - 40 : at + 7 + 40].replace("\n", " ").strip()
    assert [h.keyword for h in got[1]] == ["acil", "hemen", "hemen tıklayın"]
    assert [h.keyword for h in got[2]] == ["acil", "urgent"] and got[3] == []
    assert [h.keyword for h in got[4]] == ["acil", "iptal edilecek"]


def test_url_facts_keep_first_and_order(spark):
    df = spark.createDataFrame([([("http://a.example/1", "b.example"), ("http://a.example/1", "c")], "see http://z.example/?a=1&amp;b http://a.example/1")], "l array<struct<url:string,text:string>>, b string")
    f = df.select(U.url_facts(F.col("l"), F.col("b"), F.array(F.lit("http://q.example"))).alias("f")).first().f
    assert [x.url for x in f] == ["http://a.example/1", "http://z.example/?a=1&amp;b", "http://q.example"]
    assert f[0].text_href_mismatch and f[0].anchor_text_domain == "b.example" and not f[1].text_href_mismatch
