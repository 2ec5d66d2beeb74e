"""Schema checks and grounding: every rejection reason at least once."""

import json

from pyspark.sql import functions as F

from quillsift.operators import findings, providers

BODY = "Pay now. aaa and once only. Pay now. 😀 end"


def f(evidence, type_="payment_request", confidence=0.5, **more):
    return {"type": type_, "evidence": evidence, "model_confidence": confidence, "explanation": "", **more}


def test_grounding_ladder(spark):
    items = [f("once only"), f("Pay now"), f("aa"), f("absent"), f("  "), f("x" * 301), f("once only"), f("once only", "threat_or_fear"), f("end", "nothing"), f("end", confidence="0.5"), f("end", confidence=1), f("end", confidence=True), 5, "text", None, [], f("end", extra=1)]
    raw = spark.createDataFrame([(1, BODY, "so: ```json\n" + json.dumps(items, ensure_ascii=False) + "\n```")], "id int, body string, raw string")
    got = {r.pos: r for r in findings.ground(findings.candidates(findings.explode_raw(raw)), "id").collect()}
    want = [None, "AMBIGUOUS_EVIDENCE", "AMBIGUOUS_EVIDENCE", "NOT_FOUND_IN_BODY", "EMPTY_EVIDENCE", "EVIDENCE_TOO_LONG", "DUPLICATE_FINDING", None, "UNKNOWN_TYPE", "SCHEMA_INVALID", None, *["SCHEMA_INVALID"] * 6]
    assert [got[i].rejection_reason for i in range(len(items))] == want
    assert (got[0].start, got[0].end) == (BODY.index("once"), BODY.index("once") + 9)
    assert got[10].start == BODY.index("end")
    assert {g.stage for g in got.values() if g.rejection_reason in ("SCHEMA_INVALID", "UNKNOWN_TYPE")} == {0}
    kept = findings.accepted(findings.ground(findings.candidates(findings.explode_raw(raw)), "id"), "id").first().findings
    assert [x.type for x in kept] == ["payment_request", "threat_or_fear", "payment_request"]


def test_no_array_gives_no_rows(spark):
    raw = spark.createDataFrame([(1, "no array"), (2, None), (3, "[1, "), (4, "[]")], "id int, raw string")
    assert findings.explode_raw(raw).count() == 0


def test_providers_see_only_rows_that_need_them(spark):
    df = spark.createDataFrame([(i, "Phishing" if i % 3 == 0 else "Güvenilir") for i in range(30)], "id int, v string")
    seen = spark.sparkContext.accumulator(0)

    def provider(some):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(raw="[]")

        return some.mapInPandas(count, "id int, v string, raw string")

    out = providers.only_where(df, "id", F.col("v") != "Phishing", provider, ["raw"]).collect()
    assert seen.value == 20 and sum(r.raw is not None for r in out) == 20


def test_generated_and_narrative_status(spark):
    good = {k: "x" for k in ("risk_seviyesi", "sonuc_ve_gerekce", "genel_degerlendirme", "teknik_bulgular", "phishing_gostergeleri", "onerilen_aksiyon")}
    rows = [(json.dumps(good), "x"), (json.dumps(good), "y"), ("{}", "x"), ("nothing", "x")]
    got = [r.status for r in providers.generated(spark.createDataFrame(rows, "raw string, expected string")).collect()]
    assert got == ["ok", "verdict_mismatch", "schema_error", "invalid_json"]
    n = {"olasi_senaryo": "a", "mailin_talep_ettigi_eylem": "b", "olasi_zarar": "c"}
    rows = [("x " + json.dumps(n),), (json.dumps(n | {"d": "e"}),), (json.dumps(n | {"olasi_zarar": 1}),), ("x",), (None,)]
    got = [(r.narrative_error, r.narrative is not None) for r in providers.narrative(spark.createDataFrame(rows, "raw string")).collect()]
    assert got == [(None, True), ("schema_invalid", False), ("schema_invalid", False), ("invalid_json", False), ("model_call_failed", False)]
