"""Routing of inputs: which of them can go through triage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.functions.text import finds, looks_like_raw_email, strip

ACCEPT, FALLBACK = 0.70, 0.40


def _outcome(route: str, status: str, rule: str, code: str, source: str, scope: str | None = None) -> Column:
    values = {"route": route, "status": status, "matched_rule": rule, "reason_code": code, "confidence_source": source, "unsupported_scope": scope}
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])


def classifier_route(persona: Column, fallback: Column) -> Column:
    """Outcome of an intent provider's answer; a null persona means that it could not run."""
    sure = lambda rule, scope: _outcome("unsupported", "not_routed", rule, "unsupported_intent", "model", scope)
    other = F.struct(*[c.alias(k) for k, c in {
        "route": F.lit("unsupported"), "status": F.lit("not_routed"), "matched_rule": F.concat(F.lit("intent_"), persona),
        "reason_code": F.lit("unsupported_intent"), "confidence_source": F.lit("model"), "unsupported_scope": persona,
    }.items()])
    return (
        F.when(persona.isNull(), _outcome("needs_clarification", "not_routed", "classifier_unavailable", "classifier_unavailable", "none"))
        .when(fallback, _outcome("needs_clarification", "not_routed", "classifier_below_threshold", "ambiguous_intent", "model"))
        .when(persona == "phishing", _outcome("phishing_missing_email", "missing_input", "intent_phishing_no_email", "phishing_intent_no_email", "model"))
        .when(persona == "alakasiz", sure("intent_alakasiz", "non_cyber_request"))
        .otherwise(other)
    )


def intent(logits: Column) -> Column:
    """struct<persona, confidence, fallback> of a map of first-token logits: softmax, then the bands of confidence."""
    entries = F.map_entries(logits)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    exp = F.transform(entries, lambda e: F.struct(F.exp(e["value"] - top).alias("p"), e["key"].alias("k")))
    total = F.aggregate(exp, F.lit(0.0), lambda a, e: a + e["p"])
    best = F.array_max(exp)
    p = best["p"] / total
    return F.struct(F.when(p >= ACCEPT, best["k"]).otherwise("cybersec_qa").alias("persona"), p.alias("confidence"), (p < FALLBACK).alias("fallback"))


def route(file_exists: Column, file_name: Column, file_text: Column, text: Column, hint: Column, system: Column, persona: Column | None = None, fallback: Column | None = None) -> Column:
    """The routing outcome of an input; a null file_name means pasted text. persona: an intent provider's answer, where one is used."""
    suffix = F.lower(F.regexp_extract(file_name, r"(\.[^.]*)$", 1))
    h = F.lower(strip(F.coalesce(hint, F.lit(""))))
    some = F.coalesce(strip(text) != "", F.lit(False))
    sys = finds(system, L.TRUSTED_PHISHING)
    det, meta = "deterministic", "trusted_metadata"
    hinted = F.struct(*[c.alias(k) for k, c in {
        "route": F.lit("unsupported"), "status": F.lit("not_routed"), "matched_rule": F.lit("trusted_route_hint_unsupported"),
        "reason_code": F.lit("unsupported_intent"), "confidence_source": F.lit(meta), "unsupported_scope": h,
    }.items()])
    file = (
        F.when(~file_exists, _outcome("unsupported", "not_routed", "file_missing", "file_missing", det))
        .when(suffix == ".eml", _outcome("phishing_direct", "accepted", "file_extension", "email_file_extension", det))
        .when(looks_like_raw_email(file_text), _outcome("phishing_direct", "accepted", "file_content", "email_file_content", det))
        .when(h == "phishing", _outcome("unsupported", "not_routed", "route_payload_conflict", "route_payload_conflict", det, "non_email_payload"))
        .otherwise(_outcome("unsupported", "not_routed", "file_not_email", "file_not_email", det, "non_email_file"))
    )
    plain = _outcome("unsupported", "not_routed", "text_not_email", "unsupported_intent", det, "plain_text_without_email")
    return (
        F.when(file_name.isNotNull(), file)
        .when(some & looks_like_raw_email(text), _outcome("phishing_direct", "accepted", "pasted_email", "raw_email_headers", det))
        .when(h == "phishing", _outcome("phishing_missing_email", "missing_input", "trusted_route_hint_without_email", "trusted_route_hint", meta))
        .when(h != "", hinted)
        .when(sys, _outcome("phishing_missing_email", "missing_input", "trusted_system_intent_without_email", "trusted_system_intent", meta))
        .when(some, classifier_route(persona, fallback) if persona is not None else plain)
        .otherwise(_outcome("unsupported", "not_routed", "empty_input", "empty_input", "none"))
    )
