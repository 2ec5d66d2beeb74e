"""Messages end to end: sources, MIME, HTML, triage in both modes, streaming, sinks."""

import json
import mailbox

from pyspark.sql import functions as F

from quillsift.functions import lexicon as L
from quillsift.plans.triage import facts, triage
from quillsift.schema import EMAIL_FACTS, fact_names
from quillsift.sources import mime, readers, sinks
from quillsift.streaming import stream

PHISH = (
    b"From: \"PayPal Support\" <help@evil-site.example>\r\nReply-To: x@gmail.com\r\nReturn-Path: <b@bounce.example>\r\nMessage-ID: <1@other.example>\r\nReceived: from a ([10.0.0.9]) by b\r\nReceived: from c ([192.0.2.7]) by d\r\n"
    b"Authentication-Results: mx; spf=fail smtp.mailfrom=b@bounce.example; dkim=pass header.d=bounce.example; dmarc=fail\r\nSubject: =?utf-8?q?Acil_i=C5=9Flem?=\r\nDate: Mon, 3 Mar 2024 10:00\r\nMIME-Version: 1.0\r\n"
    b"Content-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Please verify your account password <a href=\"http://1.2.3.4/?u=http://b\">paypal.com</a>"
    b"<span style=\"display: none\">hidden words</span><form action=\"https://grab.example/p\"><img src=a></form>\r\n--x\r\n"
    b"Content-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\"bill.pdf.exe\"\r\nContent-Transfer-Encoding: base64\r\n\r\nTVqQAAM=\r\n--x--\r\n"
)
CLEAN = (
    b"From: News <news@mail.shop.example.com>\r\nReturn-Path: <b@mail.shop.example.com>\r\nAuthentication-Results: mx; spf=pass smtp.mailfrom=b@mail.shop.example.com; dkim=pass header.i=@example.com; dmarc=pass\r\n"
    b"Subject: hi\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nOur address moved. Send the payment to this account, you won a prize.\r\n"
)


def messages(spark):
    return spark.createDataFrame([("p", PHISH), ("c", CLEAN), ("bad", b"\xff\xfe\x00"), ("none", None)], "id string, content binary")


def test_facts(spark):
    got = {r.id: r for r in facts(messages(spark), "id").collect()}
    p = got["p"]
    assert (p.spf_result, p.dkim_result, p.dmarc_result, p.dkim_domain, p.dkim_domain_matches_from) == ("fail", "pass", "fail", "bounce.example", False)
    assert (p.from_domain, p.from_source, p.reply_to_domain, p.return_path_mismatch) == ("evil-site.example", "from", "gmail.com", True)
    assert p.display_name == "PayPal Support" and p.display_name_brand_mismatch and p.subject == "Acil işlem"
    assert (p.received_hop_count, p.first_received_ip, p.message_id_domain_matches_from) == (2, "192.0.2.7", False)
    u = p.urls[0]
    assert u.is_ip_based and u.redirect_param and u.anchor_text_domain == "paypal.com" and u.text_href_mismatch
    a = p.attachments[0]
    assert a.double_extension and a.risky_type and not a.extension_mismatch and a.size == 5
    assert p.has_html_form and p.form_action_domain == "grab.example" and p.has_hidden_text and not p.has_large_hidden_text
    assert p.credential_request and p.language == "en" and p.error is None
    c = got["c"]
    assert c.dkim_domain_matches_from and c.spf_aligned and c.urls == [] and not c.has_html_form
    assert got["none"].from_domain is None and got["bad"].body_text is not None
    assert len(fact_names()) == 36


def test_triage_fast_and_hybrid(spark):
    f = facts(messages(spark), "id")
    fast = {r.id: r for r in triage(f, "id").collect()}
    assert fast["p"].final_verdict == L.PHISHING and fast["c"].final_verdict == L.CLEAN
    assert all(r.report.risk_seviyesi == r.final_verdict for r in fast.values())
    said = [{"type": t, "evidence": e, "model_confidence": 0.9, "explanation": ""} for t, e in (("payment_request", "Send the payment"), ("reward_or_prize_lure", "won a prize"))]
    asked = []

    def provider(df):
        asked.append([r.id for r in df.select("id").collect()])
        return df.withColumn("raw", F.when(F.col("id") == "c", F.lit(json.dumps(said))).otherwise(F.lit("nothing")))

    hybrid = {r.id: r for r in triage(f, "id", "hybrid", provider).collect()}
    assert "p" not in asked[0] and hybrid["p"].semantic_status == "skipped"
    c = hybrid["c"]
    assert c.final_verdict == L.LIKELY and c.decision.decision_path == L.PAYMENT_UPGRADE and c.semantic_status == "completed"
    assert hybrid["bad"].semantic_status == "failed"
    assert all(r.report.risk_seviyesi == r.final_verdict for r in hybrid.values())
    second = {r.id: r.final_verdict for r in triage(f, "id", engine="v2").collect()}
    assert second["p"] == L.PHISHING and second["c"] == L.CLEAN
    page = triage(f, "id").select("id", sinks.render_html(F.col("report")).alias("page")).collect()[0].page
    assert page.startswith("<!doctype html>") and "&#x27;" in page or "<h1>" in page


def test_html_and_credential_window():
    h = mime.parse_html("<a href='HTTP://x.example'>one<b>two</a><div style='font-size:0.9em'>abc<i style='display:none'>de</i></div><script>var a='</p>'</script><p><b>end")
    assert h["links"] == [{"url": "HTTP://x.example", "text": "onetwo"}] and h["hidden_chars"] == 5 + 2
    assert "var a" not in h["text"] and not h["has_form"]
    assert mime.credential_window("please verify your password") and not mime.credential_window("we will never ask you to verify your password")
    assert not mime.credential_window("verify " + "x" * 200 + " password") and not mime.credential_window(None)
    assert mime.credential_window("şifrenizi doğrulayın")


def test_readers(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(PHISH)
    assert readers.read_eml(spark, str(tmp_path)).count() == 1
    box = mailbox.mbox(str(tmp_path / "Sent.mbox"))
    box.add(mailbox.mboxMessage(CLEAN.decode()))
    box.add(mailbox.mboxMessage(CLEAN.decode()))
    box.flush()
    spark.dataSource.register(readers.MboxSource)
    for df in (spark.read.format("mbox").load(str(tmp_path / "Sent.mbox")), readers.read_mbox(spark, str(tmp_path / "Sent.mbox"))):
        rows = df.collect()
        assert len(rows) == 2 and {r.label for r in rows} == {"sent"} and b"Our address" in bytes(rows[0].content)
    f = facts(messages(spark), "id")
    sinks.write_jsonl(f, str(tmp_path / "facts"))
    back = readers.read_facts(spark, str(tmp_path / "facts"), "id string, error string")
    assert back.count() == 4 and back.filter("id = 'p'").first().urls[0].is_ip_based
    assert [r.field for r in readers.unknown_fields(spark, str(tmp_path / "facts"), fact_names()).orderBy("field").collect()] == ["id"]
    (tmp_path / "review.md").write_text("## 1 `x/a.eml`\nlabel: phishing\n## 2 `b.eml`\nlabel: \n```yaml\na: 1\n```\n")
    assert {(r.path, r.label) for r in readers.read_markdown_labels(spark, str(tmp_path / "review.md")).collect()} == {("x/a.eml", "phishing"), ("b.eml", None)}
    assert json.loads(readers.read_yaml_blocks(spark, str(tmp_path / "review.md")).first().doc) == {"a": 1}
    assert spark.createDataFrame([], EMAIL_FACTS).count() == 0


def test_worksheets(spark):
    df = spark.createDataFrame([("a.eml", "s")], "path string, subject string")
    blocks = sinks.worksheet(df, "path", [F.concat(F.lit("subject: "), F.col("subject"))])
    assert blocks.first().block == "## `a.eml`\nsubject: s\nlabel: \n"
    assert sinks.filled_labels(blocks).first().filled == 0
    assert sinks.filled_labels(blocks.withColumn("block", F.lit("x\nlabel: spam"))).first().filled == 1


def test_stream_triages_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(PHISH)
    (tmp_path / "in" / "b.eml").write_bytes(CLEAN)
    for _ in range(2):
        s = stream.once_per_message(stream.message_stream(spark, str(tmp_path / "in")), "path")
        stream.start_triage(s, "path", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.final_verdict for r in rows) == sorted([L.PHISHING, L.CLEAN])
