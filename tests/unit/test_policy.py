"""The policy's whole truth table, reports and narratives."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.operators import policy

ASSESSMENT = "struct<rule_verdict:string,score:double,evidence:array<struct<signal:string,description:string,weight:int>>>"


def table(spark):
    rows = []
    for v in (L.PHISHING, L.LIKELY, L.CLEAN):
        for bits in itertools.product((0, 1), repeat=9):
            for ext in (False, True):
                found = [(t, "x", 10 * i, 10 * i + 3, 0.5, "") for i, t in enumerate(L.FINDING_TYPES) if bits[i]]
                rows.append((len(rows), (v, 3.0, [("spf_or_dmarc_fail", "d", 3), ("all_auth_pass_and_consistent", "e", -3)]), found, ext))
    return spark.createDataFrame(rows, f"id int, a {ASSESSMENT}, f array<{policy.FINDING}>, ext boolean")


def expected(v, types, ext):
    if v != L.CLEAN:
        return v, L.RULES_ONLY, []
    if "credential_request" in types and ext:
        return L.LIKELY, L.CREDENTIAL_UPGRADE, ["credential_request"]
    also = {"reward_or_prize_lure", "threat_or_fear", "reply_channel_manipulation"} & set(types)
    if "payment_request" in types and also:
        return L.LIKELY, L.PAYMENT_UPGRADE, [t for t in types if t == "payment_request" or t in also]
    return L.CLEAN, L.RULES_ONLY, []


def test_all_3072_cases(spark):
    df = table(spark).withColumn("d", policy.decide(F.col("a"), F.col("f"), F.col("ext")))
    df = df.withColumn("r", policy.report(F.col("a"), F.col("d"), F.col("f")))
    rows = df.collect()
    assert len(rows) == 3072
    for r in rows:
        types = [x.type for x in r.f]
        final, path, used = expected(r.a.rule_verdict, types, r.ext)
        assert (r.d.final_verdict, r.d.decision_path) == (final, path)
        assert [x.split(":")[0] for x in r.d.contributing_semantic_ids] == used
        assert (r.d.contributing_rule_ids == []) == (path != L.RULES_ONLY)
        assert r.d.analyst_review_required == (final == L.LIKELY)
        assert r.r.risk_seviyesi == final
        assert ("Rule engine kararı" in r.r.genel_degerlendirme) == (path != L.RULES_ONLY)
        assert r.r.phishing_gostergeleri == ["d"]
        assert [x.aciklama for x in r.r.teknik_bulgular] == ["d (+3 puan)", "e (-3 puan)"]


def test_sentences(spark):
    one = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "c array<string>")
    got = [r.s for r in one.select(policy.reason_sentence(F.lit(L.PHISHING), F.col("c")).alias("s")).collect()]
    assert got[0] == "Bu karar; a kategorisinin değerlendirilmesine dayanır."
    assert got[1] == "Bu karar; a ve b kategorilerinin birlikte değerlendirilmesine dayanır."
    assert got[2] == "Bu karar; a, b ve c kategorilerinin birlikte değerlendirilmesine dayanır."
    assert got[3] == L.NO_CATEGORY_REASON


def test_narrative_replaces_the_prefix_only(spark):
    text = policy.overview(F.lit(L.LIKELY), F.lit(L.CLEAN), F.lit(L.PAYMENT_UPGRADE))
    new = policy.apply_narrative(text, F.lit(" bir "), F.lit("iki."), F.lit("üç"))
    out = spark.range(1).select(new.alias("n"), text.alias("t")).first()
    assert out.n.startswith("Olası senaryo: bir. Alıcıdan beklenen eylem: iki. Olası zarar: üç. Rule engine kararı '")
    assert out.n.split(" Rule engine")[1] == out.t.split(" Rule engine")[1]
    with pytest.raises(Exception, match="first sentence"):
        spark.range(1).select(policy.apply_narrative(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit("a"), F.lit("b"), F.lit("c"))).collect()
