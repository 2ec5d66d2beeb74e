"""Both rule engines as column expressions over fact columns.

v1 adds the weights of fired signals; v2 scores four families from the strengths of their hits. Hits are arrays in the order
of the rules, so that evidence keeps its order.
"""

from __future__ import annotations

import pathlib
from functools import lru_cache, reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L

FAMILIES = ("identity", "url", "content", "payload")
EVIDENCE = "struct<signal:string,description:string,weight:int,family:string,subgroup:string,strength:int>"


@lru_cache(maxsize=4)
def load_rules(path: str | None = None) -> dict:
    """Thresholds and signals of a rules file; the package's own by default."""
    return yaml.safe_load(pathlib.Path(path or pathlib.Path(__file__).with_name("rules.yaml")).read_text(encoding="utf-8"))


def rules_table(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """(ord, signal, weight, description): one row per signal."""
    rows = [(i, k, int(v["weight"]), v["description"]) for i, (k, v) in enumerate((rules or load_rules())["signals"].items())]
    return spark.createDataFrame(rows, "ord int, signal string, weight int, description string")


def _is(name: str, value: bool) -> Column:
    return F.col(name).eqNullSafe(F.lit(value))


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _some(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


def reply_to_free_mail() -> Column:
    """Replies go to a free provider, and the sender is not at one."""
    reply, sender = F.lower("reply_to_domain"), F.lower("from_domain")
    return F.coalesce(F.col("reply_to_mismatch") & reply.isin(L.FREE_MAIL) & (sender != "") & ~sender.isin(L.FREE_MAIL), F.lit(False))


def _auth() -> dict[str, Column]:
    passed = lambda c: F.col(c).eqNullSafe(F.lit("pass"))
    missing = F.col("dkim_result").isNull() | F.col("dkim_result").isin("none", "fail")
    fail = F.col("spf_result").eqNullSafe(F.lit("fail")) | F.col("dmarc_result").eqNullSafe(F.lit("fail"))
    aligned = passed("spf_result") & passed("dkim_result") & passed("dmarc_result") & _is("dkim_domain_matches_from", True)
    return {"passed": passed, "missing": missing, "fail": fail, "aligned": aligned, "odd": _is("dkim_domain_matches_from", False)}


def _no_tld() -> Column:
    return F.coalesce((F.col("from_domain") != "") & ~F.contains("from_domain", F.lit(".")), F.lit(False))


def v1_predicates() -> list[tuple[str, Column]]:
    """(signal, condition) in firing order; conditions are never null. Reads the flat signal columns."""
    a = _auth()
    return [
        ("spf_or_dmarc_fail", a["fail"]),
        ("dkim_missing_or_fail_domain_mismatch", a["missing"] & a["odd"]),
        ("dkim_pass_but_domain_mismatch", a["passed"]("dkim_result") & a["odd"]),
        ("return_path_mismatch", _true("return_path_mismatch")),
        ("reply_to_free_mail", reply_to_free_mail()),
        ("display_name_brand_mismatch", _true("display_name_brand_mismatch")),
        ("url_text_href_mismatch", _some("url_text_href_mismatch_count")),
        ("url_ip_based", _some("url_ip_based_count")),
        ("url_punycode", _some("url_punycode_count")),
        ("url_shortener", _some("url_shortener_count")),
        ("url_redirect_param", _some("url_redirect_param_count")),
        ("has_html_form", _true("has_html_form")),
        ("display_name_has_email", _true("display_name_has_email")),
        ("attachment_risky_type", _some("attachment_risky_type_count")),
        ("attachment_double_extension", _some("attachment_double_extension_count")),
        ("hidden_text_or_image_only", _true("has_hidden_text") | _true("image_only_body")),
        ("credential_request_with_external_link", _true("credential_request") & _some("url_count")),
        ("urgency_keywords", _some("urgency_keyword_count")),
        ("is_archive_with_credential_request", _some("attachment_is_archive_count") & _true("credential_request")),
        ("claims_attachment_but_empty", _true("claims_attachment") & ~_some("attachment_count")),
        ("from_domain_no_tld", _no_tld()),
        ("all_auth_pass_and_consistent", a["aligned"]),
    ]


def _hits(entries: list[Column]) -> Column:
    return F.filter(F.array(*entries), lambda h: h.isNotNull())


def v1_matches(rules: dict | None = None) -> Column:
    """array<struct<signal, weight, description>> of fired signals."""
    signals = (rules or load_rules())["signals"]
    return _hits([F.when(p, F.struct(F.lit(s).alias("signal"), F.lit(int(signals[s]["weight"])).alias("weight"), F.lit(signals[s]["description"]).alias("description"))) for s, p in v1_predicates()])


def v1_score(rules: dict | None = None) -> Column:
    """The sum of fired weights."""
    signals = (rules or load_rules())["signals"]
    return reduce(lambda a, b: a + b, [F.when(p, F.lit(int(signals[s]["weight"]))).otherwise(F.lit(0)) for s, p in v1_predicates()])


def v1_verdict(score: Column, rules: dict | None = None) -> Column:
    """The score's band."""
    t = (rules or load_rules())["thresholds"]
    return F.when(score >= t["phishing"], L.PHISHING).when(score >= t["suspicious"], L.LIKELY).otherwise(L.CLEAN)


def evaluate_v1(facts: DataFrame, rules: dict | None = None) -> DataFrame:
    """facts with score, rule_verdict and matches; needs the flat signal columns."""
    scored = facts.withColumn("matches", v1_matches(rules)).withColumn("score", v1_score(rules))
    return scored.withColumn("rule_verdict", v1_verdict(F.col("score"), rules))


def strength(weight: int) -> int:
    """Weights as weak 1, moderate 2, strong 3."""
    return 1 if weight <= 1 else 2 if weight == 2 else 3


def v2_predicates() -> dict[str, list[tuple[str, str, Column]]]:
    """Per family (subgroup, signal, condition). Reads fact columns and url_root_mismatch_count, form_root_mismatch."""
    a = _auth()
    free, brand = reply_to_free_mail(), _true("display_name_brand_mismatch")
    dkim_ok = a["passed"]("dkim_result") & _is("dkim_domain_matches_from", True)
    url = lambda field: F.coalesce(F.exists("urls", lambda u: u[field]), F.lit(False))
    att = lambda field: F.coalesce(F.exists("attachments", lambda x: x[field]), F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    infra, pii, scam = "infrastructure_alignment", "credential_collection", "scam_narrative"
    return {
        "identity": [
            (infra, "spf_or_dmarc_fail", a["fail"]),
            (infra, "dkim_missing_or_fail_domain_mismatch", a["missing"] & a["odd"]),
            (infra, "dkim_pass_but_domain_mismatch", a["passed"]("dkim_result") & a["odd"]),
            (infra, "spf_pass_but_mailfrom_misaligned", a["passed"]("spf_result") & _is("spf_aligned", False) & ~dkim_ok),
            (infra, "return_path_mismatch", _true("return_path_mismatch") & (~a["aligned"] | free | brand)),
            (infra, "from_domain_no_tld", _no_tld()),
            ("claimed_identity", "display_name_brand_mismatch", brand),
            ("claimed_identity", "display_name_has_email", _true("display_name_has_email")),
            ("reply_routing", "reply_to_free_mail", free),
        ],
        "url": [
            ("visible_deception", "url_text_href_mismatch", _some("url_root_mismatch_count")),
            ("destination_obfuscation", "url_ip_based", url("is_ip_based")),
            ("destination_obfuscation", "url_punycode", url("has_punycode")),
            ("indirection", "url_shortener", url("is_shortener")),
            ("indirection", "url_redirect_param", url("redirect_param")),
        ],
        "content": [
            ("visual_evasion", "hidden_text_or_image_only", _true("has_large_hidden_text") | _true("image_only_body")),
            (pii, "credential_request_with_external_link", _true("credential_request") & (size("urls") > 0)),
            (pii, "has_html_form", _true("has_html_form")),
            (pii, "form_action_domain_mismatch", _true("form_root_mismatch") & _true("credential_request")),
            ("pressure", "urgency_keywords", size("urgency_keywords") > 0),
            ("attachment_lure", "claims_attachment_but_empty", _true("claims_attachment") & (size("attachments") == 0)),
            (scam, "advance_fee_fraud_language", _true("has_advance_fee_fraud_language")),
            (scam, "fake_reward_claim_language", _true("has_fake_reward_claim_language")),
        ],
        "payload": [
            ("dangerous_type", "attachment_risky_type", att("risky_type")),
            ("filename_disguise", "attachment_double_extension", att("double_extension")),
            ("filename_disguise", "attachment_extension_mismatch", att("extension_mismatch")),
            ("archive", "attachment_is_archive", att("is_archive")),
        ],
    }


def _evidence(family: str, subgroup: str, signal: str, signals: dict) -> Column:
    rule = signals.get(signal, {"weight": 1, "description": signal.replace("_", " ")})
    values = {"signal": signal, "description": rule["description"], "weight": int(rule["weight"]), "family": family, "subgroup": subgroup, "strength": strength(int(rule["weight"]))}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def family_score(hits: Column) -> Column:
    """Highest strength, one more with two subgroups, 4 at most; 0 without hits."""
    top = F.array_max(F.transform(hits, lambda h: h["strength"]))
    groups = F.size(F.array_distinct(F.transform(hits, lambda h: h["subgroup"])))
    return F.when(F.size(hits) == 0, F.lit(0)).otherwise(F.least(F.lit(4), top + (groups >= 2).cast("int")))


def critical_matches() -> Column:
    """Names of conditions that decide alone."""
    both = F.coalesce(F.exists("attachments", lambda a: a["double_extension"] & a["risky_type"]), F.lit(False))
    return _hits([F.when(both, F.lit("double_extension_and_risky_type_same_attachment"))])


def with_roots(facts: DataFrame, key: str) -> DataFrame:
    """facts with url_root_mismatch_count and form_root_mismatch by registrable domains; key names a unique column."""
    from quillsift.functions.urls import registrable_domains

    pairs = facts.select(key, F.explode("urls").alias("u")).select(key, F.col("u.anchor_text_domain").alias("shown"), F.col("u.href_domain").alias("href")).filter("shown IS NOT NULL AND href IS NOT NULL")
    rooted = registrable_domains(pairs, "shown", "href").groupBy(key).agg(F.count_if(F.col("shown_root") != F.col("href_root")).cast("int").alias("url_root_mismatch_count"))
    out = registrable_domains(facts, "form_action_domain", "from_domain").join(rooted, key, "left")
    form = F.col("form_action_domain").isNotNull() & F.col("from_domain").isNotNull() & ~F.col("form_action_domain_root").eqNullSafe(F.col("from_domain_root"))
    return out.withColumn("url_root_mismatch_count", F.coalesce("url_root_mismatch_count", F.lit(0))).withColumn("form_root_mismatch", form).drop("form_action_domain_root")


def evaluate_v2(facts: DataFrame, rules: dict | None = None) -> DataFrame:
    """facts with <family>_hits, <family>_score, critical, total, active, material and verdict_v2."""
    signals = (rules or load_rules())["signals"]
    out = facts
    for family, entries in v2_predicates().items():
        hits = _hits([F.when(p, _evidence(family, g, s, signals)) for g, s, p in entries])
        out = out.withColumn(f"{family}_hits", hits)
        out = out.withColumn(f"{family}_score", family_score(F.col(f"{family}_hits")))
    scores = [F.col(f"{f}_score") for f in FAMILIES]
    count = lambda n: reduce(lambda a, b: a + b, [(s >= n).cast("int") for s in scores])
    out = out.withColumn("critical", critical_matches()).withColumn("total", reduce(lambda a, b: a + b, scores))
    out = out.withColumn("active", count(1)).withColumn("material", count(2))
    top = F.greatest(*scores)
    sure = (F.size("critical") > 0) | (top == 4) | ((F.col("total") >= 5) & (F.col("material") >= 2))
    likely = (top >= 3) | ((F.col("total") >= 3) & (F.col("active") >= 2))
    return out.withColumn("verdict_v2", F.when(sure, L.PHISHING).when(likely, L.LIKELY).otherwise(L.CLEAN))


def assessment_v1(rules: dict | None = None) -> Column:
    """The engine-neutral result of evaluate_v1's columns."""
    t = (rules or load_rules())["thresholds"]
    evidence = F.transform("matches", lambda m: F.struct(m["signal"].alias("signal"), m["description"].alias("description"), m["weight"].alias("weight"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("subgroup"), F.lit(None).cast("int").alias("strength")))
    reason = F.format_string(f"score %s vs thresholds (phishing>={t['phishing']}, suspicious>={t['suspicious']})", F.col("score").cast("string"))
    return F.struct(
        F.lit("v1").alias("engine_version"), F.col("rule_verdict"), F.col("score").cast("double").alias("score"), F.lit(None).cast("int").alias("total"),
        F.array().cast("array<struct<family:string,score:int>>").alias("families"), F.array().cast("array<string>").alias("critical_matches"),
        evidence.alias("evidence"), F.array(reason).alias("decision_reasons"),
    )


def assessment_v2() -> Column:
    """The engine-neutral result of evaluate_v2's columns."""
    named = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"{f}_score").alias("score")) for f in FAMILIES])
    listed = lambda least, exact: F.array_join(F.transform(F.filter(named, lambda x: (x["score"] == least) if exact else (x["score"] >= least)), lambda x: x["family"]), ", ")
    top = F.greatest(*[F.col(f"{f}_score") for f in FAMILIES])
    reasons = [
        F.when(F.size("critical") > 0, F.concat(F.lit("critical predicate matched: "), F.array_join("critical", ", "))),
        F.when(top == 4, F.concat(F.lit("family score 4 (two independent mechanisms) in: "), listed(4, True))),
        F.when((F.col("total") >= 5) & (F.col("material") >= 2), F.format_string("total=%d (>=5) with material_family_count=%d (>=2)", "total", "material")),
        F.when(top >= 3, F.concat(F.lit("family score >=3 in: "), listed(3, False))),
        F.when((F.col("total") >= 3) & (F.col("active") >= 2), F.format_string("total=%d (>=3) with active_family_count=%d (>=2)", "total", "active")),
    ]
    found = _hits(reasons)
    none = F.array(F.format_string("no threshold met (total=%d, active_family_count=%d)", "total", "active"))
    return F.struct(
        F.lit("v2").alias("engine_version"), F.col("verdict_v2").alias("rule_verdict"), F.lit(None).cast("double").alias("score"), F.col("total"),
        named.alias("families"), F.col("critical").alias("critical_matches"), F.concat(*[F.col(f"{f}_hits") for f in FAMILIES]).alias("evidence"),
        F.when(F.size(found) == 0, none).otherwise(found).alias("decision_reasons"),
    )
