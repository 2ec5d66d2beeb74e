"""Mail-shaped columns derived from the provided tables, as SQL that Spark and DuckDB read alike.

Each template names its tables in braces; `spark_view` fills in DataFrames, `sql` plain table names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNALS = """SELECT event_id AS id, event_type,
  CASE event_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' WHEN 2 THEN 'softfail' ELSE 'pass' END AS spf_result,
  CASE event_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN NULL WHEN 2 THEN 'none' ELSE 'pass' END AS dkim_result,
  CASE event_id % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END AS dmarc_result,
  CASE event_id % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS dkim_domain_matches_from,
  CASE event_id % 6 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS spf_aligned,
  CASE event_id % 17 WHEN 0 THEN 'localhost' WHEN 1 THEN 'gmail.com' WHEN 2 THEN NULL ELSE 'corp.example.com' END AS from_domain,
  CASE event_id % 19 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Yahoo.com' WHEN 2 THEN NULL ELSE 'corp.example.com' END AS reply_to_domain,
  event_id % 13 = 0 AS return_path_mismatch, event_id % 3 = 1 AS reply_to_mismatch,
  event_id % 23 = 0 AS display_name_brand_mismatch, event_id % 29 = 0 AS display_name_has_email,
  event_id % 31 = 0 AS url_differs, event_id % 37 = 0 AS url_ip, event_id % 41 = 0 AS url_puny, event_id % 43 = 0 AS url_short, event_id % 47 = 0 AS url_redirect,
  CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_urls,
  event_id % 53 = 0 AS has_html_form, event_id % 59 = 0 AS has_hidden_text, event_id % 118 = 0 AS has_large_hidden_text, event_id % 61 = 0 AS image_only_body,
  event_id % 8 = 0 AS credential_request, event_id % 10 = 0 AS urgent, event_id % 15 = 0 AS claims_attachment,
  event_id % 67 = 0 AS risky, event_id % 71 = 0 AS doubled, event_id % 73 = 0 AS mismatched, event_id % 9 = 0 AS archived,
  CASE WHEN event_id % 67 = 0 OR event_id % 71 = 0 OR event_id % 73 = 0 OR event_id % 9 = 0 THEN 1 ELSE 0 END AS n_attachments,
  event_id % 79 = 0 AS advance_fee, event_id % 83 = 0 AS fake_reward, event_id % 24 = 0 AS form_differs,
  CASE event_id % 3 WHEN 0 THEN 'phishing' ELSE 'legitimate' END AS label
FROM {events}"""

FINDINGS = """SELECT id, kind, CASE kind WHEN 0 THEN 'credential_request' WHEN 1 THEN 'payment_request' WHEN 2 THEN 'reward_or_prize_lure'
    WHEN 3 THEN 'threat_or_fear' WHEN 4 THEN 'reply_channel_manipulation' WHEN 5 THEN 'authority_impersonation' ELSE 'urgency_or_pressure' END AS type,
  CAST(10 * kind AS INT) AS s, CAST(10 * kind + 5 + id % 5 AS INT) AS e
FROM (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE event_id % 5 END AS kind FROM {events}
  UNION ALL SELECT event_id AS id, (event_id + 3) % 7 AS kind FROM {events} WHERE event_id % 3 = 0) AS k"""

TEXTS = """SELECT doc_id, lang, source, concat(text, CASE doc_id % 12
  WHEN 0 THEN ' Please verify your account password now, click here: https://login.example.com/a?url=http://x.example.org within 24 hours.'
  WHEN 1 THEN ' The invoice is attached. Act now, this is urgent.' WHEN 2 THEN ' You are the next of kin and beneficiary of an outstanding fund.'
  WHEN 3 THEN ' Claim your reward, you have won; newsletter and unsubscribe below.' WHEN 4 THEN ' Write to sales@shop.example.net or 10.20.30.40, see https://bit.ly/abc#top.'
  WHEN 5 THEN ' merhaba ve selam bir' WHEN 6 THEN ' Dear John Smith, your casino bonus waits.' WHEN 7 THEN ' Hello Maria Lopez: flash sale with promo code.'
  WHEN 8 THEN ' My paypal account has been suspended.' ELSE '' END) AS text FROM {documents}"""

FILES = """SELECT p_partkey AS id, concat('file', p_partkey, CASE p_partkey % 9 WHEN 0 THEN '.pdf.exe' WHEN 1 THEN '.zip' WHEN 2 THEN '.docm'
  WHEN 3 THEN '.v1.backup.rar' WHEN 4 THEN '' WHEN 5 THEN '.PDF' WHEN 6 THEN '.tar.gz' WHEN 7 THEN '.longext.exe' ELSE '.doc' END) AS name,
  CASE p_partkey % 7 WHEN 0 THEN '255044462D312E34' WHEN 1 THEN '504B0304' WHEN 2 THEN '4D5A9000' WHEN 3 THEN 'D0CF11E0A1B11AE1' WHEN 4 THEN '' WHEN 5 THEN '526172211A0700' ELSE '68656C6C6F' END AS head
FROM {part}"""

DOMAINS = """SELECT page_id, CASE page_id % 12 WHEN 0 THEN concat('Mail.shop', page_id % 50, '.co.uk') WHEN 1 THEN concat('www.office', page_id % 50, '.gov.tr')
    WHEN 2 THEN 'gov.tr' WHEN 3 THEN 'co.uk' WHEN 4 THEN concat('host', page_id % 5, '.totallyfaketld') WHEN 5 THEN 'a.b.c.kobe.jp' WHEN 6 THEN 'x.city.kobe.jp'
    WHEN 7 THEN 'www.ck' WHEN 8 THEN '10.0.0.1' WHEN 9 THEN NULL ELSE 'news.example.com' END AS host,
  CASE page_id % 12 WHEN 0 THEN concat('shop', page_id % 25, '.co.uk') WHEN 1 THEN 'office7.gov.tr' WHEN 2 THEN 'www.turkiye.gov.tr' WHEN 3 THEN 'com'
    WHEN 4 THEN 'host1.totallyfaketld' WHEN 5 THEN 'z.b.c.kobe.jp' WHEN 6 THEN 'y.kobe.jp' WHEN 8 THEN '10.0.0.1' ELSE 'example.com' END AS other FROM {pages}"""

#: What the suffix list makes of DOMAINS' hosts: a suffix of two labels, bare suffixes, an unknown one, a wildcard and exceptions.
ROOTS = """SELECT page_id, lower(host) AS host, other, CASE page_id % 12 WHEN 0 THEN concat('shop', page_id % 50, '.co.uk') WHEN 1 THEN concat('office', page_id % 50, '.gov.tr')
    WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN host WHEN 5 THEN 'b.c.kobe.jp' WHEN 6 THEN 'city.kobe.jp' WHEN 7 THEN 'www.ck' WHEN 8 THEN host WHEN 9 THEN NULL ELSE 'example.com' END AS root,
  CASE page_id % 12 WHEN 0 THEN page_id % 50 = page_id % 25 WHEN 1 THEN page_id % 50 = 7 WHEN 3 THEN TRUE WHEN 4 THEN page_id % 5 = 1 WHEN 5 THEN TRUE
    WHEN 8 THEN TRUE WHEN 10 THEN TRUE WHEN 11 THEN TRUE ELSE FALSE END AS same FROM """ + "(" + DOMAINS + ") AS d"

RUNS = """SELECT event_id AS seq, user_id, event_type = 'purchase' OR event_id % 5 = 0 AS hard_failure, value AS elapsed_seconds FROM {events}"""

SHADOW = """SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'tr' WHEN 2 THEN 'de' ELSE 'xx' END AS language,
  CASE vec_id % 3 WHEN 0 THEN 'Phishing' ELSE 'Güvenilir' END AS rule_verdict,
  vec_id % 5 <> 0 AS a_usable, CAST(vec_id % 16 AS DOUBLE) / 16 AS a_prob, vec_id % 7 <> 0 AS b_usable, CAST((vec_id + 5) % 8 AS DOUBLE) / 8 AS b_prob,
  vec_id % 9 <> 0 AS c_usable, CAST((vec_id * 3) % 32 AS DOUBLE) / 32 AS c_prob FROM {embeddings}"""

SPANS = """SELECT event_id % 497 AS candidate, CASE event_id % 9 WHEN 0 THEN 'credential_request' WHEN 1 THEN 'payment_request' WHEN 2 THEN 'authority_impersonation'
    WHEN 3 THEN 'brand_impersonation' WHEN 4 THEN 'urgency_or_pressure' WHEN 5 THEN 'threat_or_fear' WHEN 6 THEN 'reward_or_prize_lure'
    WHEN 7 THEN 'attachment_or_link_instruction' ELSE 'reply_channel_manipulation' END AS type,
  CAST(event_id % 40 AS INT) AS s, CAST(event_id % 40 + 5 + event_id % 7 AS INT) AS e, event_id % 11 < 5 AS is_truth, event_id % 13 < 6 AS is_found
FROM {events}"""


def tables(template: str) -> list[str]:
    """The tables a template names."""
    return sorted(set(re.findall(r"\{(\w+)\}", template)))


def sql(template: str) -> str:
    """A template for DuckDB, in brackets."""
    return "(" + template.format(**{t: t for t in tables(template)}) + ")"


def spark_view(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A template over the tables of sf_dir."""
    return spark.sql(template, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(template)})


def flat(df: DataFrame) -> DataFrame:
    """SIGNALS with the flat signal columns of the first rule engine."""
    count = lambda c: F.col(c).cast("int")
    names = {"url_text_href_mismatch": "url_differs", "url_ip_based": "url_ip", "url_punycode": "url_puny", "url_shortener": "url_short", "url_redirect_param": "url_redirect", "attachment_risky_type": "risky", "attachment_double_extension": "doubled", "attachment_is_archive": "archived", "urgency_keyword": "urgent"}
    out = df.withColumns({f"{k}_count": count(v) for k, v in names.items()})
    return out.withColumn("url_count", F.col("n_urls")).withColumn("attachment_count", F.col("n_attachments"))


def nested(df: DataFrame) -> DataFrame:
    """SIGNALS with list columns, as the second rule engine reads them."""
    first = lambda i, c: (i == 1) & F.col(c)

    def url(i: Column) -> Column:
        return F.struct(F.concat(F.lit("https://h.example.org/"), i.cast("string")).alias("url"), F.lit("h.example.org").alias("href_domain"), F.when(first(i, "url_differs"), "other.example.net").alias("anchor_text_domain"), first(i, "url_differs").alias("text_href_mismatch"), first(i, "url_ip").alias("is_ip_based"), first(i, "url_short").alias("is_shortener"), first(i, "url_puny").alias("has_punycode"), first(i, "url_redirect").alias("redirect_param"))

    def att(i: Column) -> Column:
        return F.struct(F.lit("a.bin").alias("filename"), F.lit("application/octet-stream").alias("mime_type"), F.lit(1).cast("long").alias("size"), first(i, "doubled").alias("double_extension"), first(i, "risky").alias("risky_type"), first(i, "archived").alias("is_archive"), first(i, "mismatched").alias("extension_mismatch"))

    listed = lambda n, f: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1))), lambda i: F.when(F.col(n) > 0, f(i))), lambda x: x.isNotNull())
    hit = F.array(F.struct(F.lit("urgent").alias("keyword"), F.lit("urgent").alias("context")))
    return (
        df.withColumn("urls", listed("n_urls", url)).withColumn("attachments", listed("n_attachments", att))
        .withColumn("urgency_keywords", F.when(F.col("urgent"), hit).otherwise(F.array().cast("array<struct<keyword:string,context:string>>")))
        .withColumn("has_advance_fee_fraud_language", F.col("advance_fee")).withColumn("has_fake_reward_claim_language", F.col("fake_reward"))
        .withColumn("form_action_domain", F.when(F.col("form_differs"), "forms.example.net")).withColumn("url_root_mismatch_count", F.col("url_differs").cast("int"))
        .withColumn("form_root_mismatch", F.col("form_differs") & F.col("from_domain").isNotNull())
    )


def findings_of(df: DataFrame) -> DataFrame:
    """FINDINGS as (id, findings)."""
    f = F.struct("kind", F.col("type"), F.lit("x").alias("evidence"), F.col("s").alias("start"), F.col("e").alias("end"), F.lit(0.5).alias("model_confidence"), F.lit("").alias("explanation"))
    return df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(f)), lambda x: x.dropFields("kind")).alias("findings"))
