"""Both engines against a row evaluator that is written apart from them."""

import random

from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.operators import rules
from quillsift.plans import fixtures as X

FLAGS = "return_path_mismatch reply_to_mismatch display_name_brand_mismatch display_name_has_email url_differs url_ip url_puny url_short url_redirect has_html_form has_hidden_text has_large_hidden_text image_only_body credential_request urgent claims_attachment risky doubled mismatched archived advance_fee fake_reward form_differs".split()


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.choice((0.03, 0.15, 0.4))
        r = {f: rng.random() < p for f in FLAGS}
        r |= {
            "id": i, "spf_result": rng.choice(["pass", "fail", "none", "softfail", None]), "dkim_result": rng.choice(["pass", "fail", "none", None, "temperror"]), "dmarc_result": rng.choice(["pass", "pass", "fail", None]),
            "dkim_domain_matches_from": rng.choice([True, False, None]), "spf_aligned": rng.choice([True, False, None]),
            "from_domain": rng.choice(["corp.example.com", "localhost", "Gmail.com", None, ""]), "reply_to_domain": rng.choice(["gmail.com", "YAHOO.com", "corp.example.com", None]),
        }
        r["n_urls"] = rng.randrange(1, 3) if any(r[f] for f in ("url_differs", "url_ip", "url_puny", "url_short", "url_redirect")) else rng.randrange(2)
        r["n_attachments"] = 1 if any(r[f] for f in ("risky", "doubled", "mismatched", "archived")) else rng.randrange(2)
        out.append(r)
    return out


def free(r):
    reply, sender = (r["reply_to_domain"] or "").lower(), (r["from_domain"] or "").lower()
    return bool(r["reply_to_mismatch"] and reply in L.FREE_MAIL and sender and sender not in L.FREE_MAIL)


def v1(r):
    s = 0
    s += 3 * (r["spf_result"] == "fail" or r["dmarc_result"] == "fail")
    odd = r["dkim_domain_matches_from"] is False
    s += 2 * (r["dkim_result"] in (None, "none", "fail") and odd)
    s += 3 * (r["dkim_result"] == "pass" and odd)
    s += 2 * r["return_path_mismatch"] + 3 * free(r) + 3 * r["display_name_brand_mismatch"] + 3 * r["url_differs"] + 2 * r["url_ip"] + 3 * r["url_puny"] + 2 * r["url_short"] + 2 * r["url_redirect"]
    s += 3 * r["has_html_form"] + 2 * r["display_name_has_email"] + 3 * r["risky"] + 4 * r["doubled"] + 2 * (r["has_hidden_text"] or r["image_only_body"])
    s += 2 * (r["credential_request"] and r["n_urls"] > 0) + r["urgent"] + 2 * (r["archived"] and r["credential_request"]) + 2 * (r["claims_attachment"] and r["n_attachments"] == 0)
    s += 3 * bool(r["from_domain"] and "." not in r["from_domain"])
    s -= 3 * (r["spf_result"] == r["dkim_result"] == r["dmarc_result"] == "pass" and r["dkim_domain_matches_from"] is True)
    return s, "Phishing" if s >= 5 else "Muhtemel Phishing" if s >= 3 else "Güvenilir"


def v2(r):
    aligned = r["spf_result"] == r["dkim_result"] == r["dmarc_result"] == "pass" and r["dkim_domain_matches_from"] is True
    odd, dkim = r["dkim_domain_matches_from"] is False, r["dkim_result"]
    hits = {"identity": {}, "url": {}, "content": {}, "payload": {}}

    def add(family, group, weight, when):
        if when:
            hits[family][group] = max(hits[family].get(group, 0), min(3, max(1, weight)))

    i = "infra"
    add("identity", i, 3, r["spf_result"] == "fail" or r["dmarc_result"] == "fail")
    add("identity", i, 2, dkim in (None, "none", "fail") and odd)
    add("identity", i, 3, dkim == "pass" and odd)
    add("identity", i, 3, r["spf_result"] == "pass" and r["spf_aligned"] is False and not (dkim == "pass" and r["dkim_domain_matches_from"] is True))
    add("identity", i, 2, r["return_path_mismatch"] and (not aligned or free(r) or r["display_name_brand_mismatch"]))
    add("identity", i, 3, bool(r["from_domain"] and "." not in r["from_domain"]))
    add("identity", "claimed", 3, r["display_name_brand_mismatch"])
    add("identity", "claimed", 2, r["display_name_has_email"])
    add("identity", "reply", 3, free(r))
    add("url", "visible", 3, r["url_differs"])
    add("url", "hidden", 2, r["url_ip"])
    add("url", "hidden", 3, r["url_puny"])
    add("url", "indirect", 2, r["url_short"] or r["url_redirect"])
    add("content", "visual", 2, r["has_large_hidden_text"] or r["image_only_body"])
    add("content", "credential", 2, r["credential_request"] and r["n_urls"] > 0)
    add("content", "credential", 3, r["has_html_form"])
    add("content", "credential", 4, r["form_differs"] and r["from_domain"] is not None and r["credential_request"])
    add("content", "pressure", 1, r["urgent"])
    add("content", "lure", 2, r["claims_attachment"] and r["n_attachments"] == 0)
    add("content", "scam", 1, r["advance_fee"] or r["fake_reward"])
    add("payload", "type", 3, r["risky"])
    add("payload", "disguise", 4, r["doubled"] or r["mismatched"])
    add("payload", "archive", 1, r["archived"])
    s = {f: min(4, max(h.values()) + (len(h) >= 2)) if h else 0 for f, h in hits.items()}
    v = list(s.values())
    if (r["risky"] and r["doubled"]) or 4 in v or (sum(v) >= 5 and sum(x >= 2 for x in v) >= 2):
        return v, "Phishing"
    return v, "Muhtemel Phishing" if max(v) >= 3 or (sum(v) >= 3 and sum(x >= 1 for x in v) >= 2) else "Güvenilir"


SCHEMA = "id int, spf_result string, dkim_result string, dmarc_result string, dkim_domain_matches_from boolean, spf_aligned boolean, from_domain string, reply_to_domain string, n_urls int, n_attachments int, " + ", ".join(f"{f} boolean" for f in FLAGS)


def frame(spark, data):
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in data], SCHEMA)


def test_first_engine_on_random_vectors(spark):
    data = rows(12_000, 1)
    got = {r.id: r for r in rules.evaluate_v1(X.flat(frame(spark, data))).select("id", "score", "rule_verdict", F.expr("aggregate(matches.weight, 0, (a, w) -> a + w)").alias("sum")).collect()}
    for r in data:
        want = v1(r)
        assert (got[r["id"]].score, got[r["id"]].rule_verdict) == want, r
        assert got[r["id"]].sum == want[0]


def test_second_engine_on_random_vectors(spark):
    data = rows(12_000, 2)
    got = {r.id: r for r in rules.evaluate_v2(X.nested(frame(spark, data))).select("id", *[f"{f}_score" for f in rules.FAMILIES], "verdict_v2").collect()}
    for r in data:
        g = got[r["id"]]
        assert ([g[f"{f}_score"] for f in rules.FAMILIES], g.verdict_v2) == v2(r), r


def test_evidence_keeps_its_order_and_weights(spark):
    data = rows(200, 3)
    order = [s for s, _ in rules.v1_predicates()] if spark else []
    for r in rules.evaluate_v1(X.flat(frame(spark, data))).select("matches").collect():
        places = [order.index(m.signal) for m in r.matches]
        assert places == sorted(places)
        assert all(m.weight == rules.load_rules()["signals"][m.signal]["weight"] for m in r.matches)


def test_assessments_agree_with_engines(spark):
    df = X.nested(rules.evaluate_v1(X.flat(frame(spark, rows(500, 4)))))
    df = rules.evaluate_v2(df).withColumn("a", rules.assessment_v1()).withColumn("b", rules.assessment_v2())
    for r in df.select("score", "rule_verdict", "verdict_v2", "total", "a", "b").collect():
        assert r.a.rule_verdict == r.rule_verdict and r.a.score == r.score and r.a.total is None
        assert r.a.decision_reasons == [f"score {r.score} vs thresholds (phishing>=5, suspicious>=3)"]
        assert r.b.rule_verdict == r.verdict_v2 and r.b.total == r.total and len(r.b.families) == 4 and r.b.decision_reasons
        for e in r.b.evidence:
            assert e.strength == rules.strength(e.weight)
