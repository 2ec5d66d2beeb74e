"""Decision context, policy and reports as column expressions over assessment and findings structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L

FINDING = "struct<type:string,evidence:string,start:int,end:int,model_confidence:double,explanation:string>"
_COMBINED = ("reward_or_prize_lure", "threat_or_fear", "reply_channel_manipulation")


def has_external_url(urls: Column, from_domain: Column) -> Column:
    """A link to another host than the sender's; hosts are compared as they are (see external_by_root for organisations)."""
    return F.coalesce(F.exists(urls, lambda u: u["href_domain"].isNotNull() & ~u["href_domain"].eqNullSafe(F.lower(from_domain))), F.lit(False))


def external_by_root(facts: DataFrame, key: str) -> DataFrame:
    """facts with has_external_url: a link whose organisation is not the sender's."""
    from quillsift.functions.urls import registrable_domains, same_organization

    links = facts.select(key, F.lower("from_domain").alias("sender"), F.explode("urls").alias("u")).select(key, "sender", F.col("u.href_domain").alias("href")).filter("href IS NOT NULL")
    rooted = registrable_domains(links, "href", "sender")
    outside = ~same_organization(F.col("href"), F.col("sender"), F.col("href_root"), F.col("sender_root"))
    found = rooted.groupBy(key).agg(F.bool_or(outside).alias("has_external_url"))
    return facts.join(found, key, "left").withColumn("has_external_url", F.coalesce("has_external_url", F.lit(False)))


def semantic_id(f: Column) -> Column:
    """type:start-end."""
    return F.concat(f["type"], F.lit(":"), f["start"].cast("string"), F.lit("-"), f["end"].cast("string"))


def decide(assessment: Column, findings: Column, external: Column) -> Column:
    """The final decision. Findings move a clean verdict up one band; their confidence is never read."""
    verdict = assessment["rule_verdict"]
    types = F.coalesce(F.transform(findings, lambda f: f["type"]), F.array().cast("array<string>"))
    has = lambda t: F.array_contains(types, t)
    credential = (verdict == L.CLEAN) & has("credential_request") & external
    combined = F.arrays_overlap(types, F.array(*map(F.lit, _COMBINED)))
    payment = (verdict == L.CLEAN) & has("payment_request") & combined & ~credential
    path = F.when(credential, L.CREDENTIAL_UPGRADE).when(payment, L.PAYMENT_UPGRADE).otherwise(L.RULES_ONLY)
    final = F.when(credential | payment, L.LIKELY).otherwise(verdict)
    ids = lambda wanted: F.transform(F.filter(findings, lambda f: f["type"].isin(*wanted)), semantic_id)
    none = F.array().cast("array<string>")
    semantic = F.when(credential, ids(["credential_request"])).when(payment, ids(["payment_request", *_COMBINED])).otherwise(none)
    rules = F.when(credential | payment, none).otherwise(F.transform(assessment["evidence"], lambda e: e["signal"]))
    return F.struct(
        verdict.alias("rule_verdict"), final.alias("final_verdict"), path.alias("decision_path"), rules.alias("contributing_rule_ids"),
        semantic.alias("contributing_semantic_ids"), (final == L.LIKELY).alias("analyst_review_required"),
    )


def categories(signals: Column, types: Column) -> Column:
    """The categories that signals and finding types support, in their fixed order."""
    found = []
    for name, own, kinds in zip(L.CATEGORIES, L.CATEGORY_SIGNALS, L.CATEGORY_FINDINGS, strict=True):
        hit = F.arrays_overlap(signals, F.array(*map(F.lit, own.split())))
        if kinds:
            hit = hit | F.arrays_overlap(types, F.array(*map(F.lit, kinds.split())))
        found.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def reason_sentence(verdict: Column, cats: Column) -> Column:
    """Why, by categories; one fixed sentence for clean mail and one without categories."""
    n = F.size(cats)
    joined = F.when(n == 1, F.get(cats, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(cats, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" ve "), F.element_at(cats, -1)))
    ending = F.when(n == 1, "kategorisinin değerlendirilmesine dayanır.").otherwise("kategorilerinin birlikte değerlendirilmesine dayanır.")
    text = F.when(n == 0, F.lit(L.NO_CATEGORY_REASON)).otherwise(F.concat(F.lit("Bu karar; "), joined, F.lit(" "), ending))
    return F.when(verdict == L.CLEAN, F.lit(L.CLEAN_REASON)).otherwise(text)


def _by_verdict(verdict: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def overview(verdict: Column, rule_verdict: Column, path: Column) -> Column:
    """Three sentences of scenario, action and harm, and what moved the verdict if something did."""
    text = F.concat(F.lit("Olası senaryo: "), _by_verdict(verdict, L.SCENARIO), F.lit(f". Alıcıdan beklenen eylem: {L.EXPECTED_ACTION}. Olası zarar: "), _by_verdict(verdict, L.HARM), F.lit("."))
    moved = F.concat(F.lit(" Rule engine kararı '"), rule_verdict, F.lit("' idi, ancak "), _by_verdict(path, L.UPGRADE_REASON), F.lit(" nihai karar '"), verdict, F.lit("' olarak güncellendi."))
    return F.concat(text, F.coalesce(F.when(path != L.RULES_ONLY, moved), F.lit("")))


def report(assessment: Column, decision: Column | None = None, findings: Column | None = None) -> Column:
    """The analyst's report; its risk level is the final verdict."""
    verdict = decision["final_verdict"] if decision is not None else assessment["rule_verdict"]
    path = decision["decision_path"] if decision is not None else F.lit(L.RULES_ONLY)
    evidence = assessment["evidence"]
    signals = F.transform(evidence, lambda e: e["signal"])
    types = F.array().cast("array<string>")
    if decision is not None:
        signals = F.array_intersect(signals, decision["contributing_rule_ids"])
        if findings is not None:
            types = F.transform(F.filter(findings, lambda f: F.array_contains(decision["contributing_semantic_ids"], semantic_id(f))), lambda f: f["type"])
    points = lambda w: F.concat(F.when(w >= 0, "+").otherwise(""), w.cast("string"))
    return F.struct(
        verdict.alias("risk_seviyesi"),
        reason_sentence(verdict, categories(signals, types)).alias("sonuc_ve_gerekce"),
        overview(verdict, assessment["rule_verdict"], path).alias("genel_degerlendirme"),
        F.transform(evidence, lambda e: F.struct(F.replace(e["signal"], F.lit("_"), F.lit(" ")).alias("baslik"), F.concat(e["description"], F.lit(" ("), points(e["weight"]), F.lit(" puan)")).alias("aciklama"))).alias("teknik_bulgular"),
        F.transform(F.filter(evidence, lambda e: e["weight"] > 0), lambda e: e["description"]).alias("phishing_gostergeleri"),
        _by_verdict(verdict, L.ACTIONS).alias("onerilen_aksiyon"),
    )


def apply_narrative(text: Column, scenario: Column, action: Column, harm: Column) -> Column:
    """overview's three sentences replaced, what follows them kept; an error where they are missing."""
    dot = lambda s: F.concat(F.regexp_replace(s, r"(?U)\A\s+|\s+\z", ""), F.when(F.endswith(F.regexp_replace(s, r"(?U)\s+\z", ""), F.lit(".")), "").otherwise("."))
    marker = " Rule engine kararı '"
    suffix = F.when(F.contains(text, F.lit(marker)), F.substr(text, F.locate(marker, text))).otherwise("")
    new = F.concat(F.lit("Olası senaryo: "), dot(scenario), F.lit(" Alıcıdan beklenen eylem: "), dot(action), F.lit(" Olası zarar: "), dot(harm), suffix)
    return F.when(F.contains(text, F.lit("Olası senaryo: ")), new).otherwise(F.raise_error(F.lit("the overview's first sentence is missing")).cast("string"))
