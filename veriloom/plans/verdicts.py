"""Queries of findings, ladders, senders, chats and signals: documents and pages as messages.

A message is a document: its first mail domain (else its source's) is the sender, its findings are what the pack's
patterns find. The pack and the lists are inputs of the queries, stated on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import entities, text, urls
from veriloom.operators import chokepoints, registers, rollups, scoring, verdicts
from veriloom.plans.base import query

C = F.col
PACK = [
    ("MONEY", "CARD_NUMBER", 5, "[0-9]{16}"), ("MONEY", "PAY_HOST", 3, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("DELIVERY", "CREDENTIAL", 4, "password="),
    ("CLAIM", "PRESSURE", 3, r"\$\$\$"), ("CLAIM", "SECRET", 4, "token = "), ("ENTITY", "PHONE", 2, r"\+1 \("), ("EMAIL_AUTH", "FREE_MAIL", 3, r"@mail[0-9]+\.example\.com"),
]
CHECKS = ["MONEY", "DELIVERY", "CLAIM", "ENTITY", "EMAIL_AUTH"]
OUT, WAYS = ["CARD_NUMBER"], ["MONEY", "DELIVERY"]


def messages(t):
    mail = F.regexp_extract("text", r"@([a-z0-9]+\.example\.com)", 1)
    return t("documents").select(
        C("doc_id").alias("msg_id"), "text", "source", F.when(mail != "", mail).otherwise(F.concat("source", F.lit(".example.org"))).alias("from_domain"),
        (C("text").contains("token = ") | C("text").contains("password=") | C("text").rlike("[0-9]{16}")).alias("asks"), C("text").contains("Licens").alias("known_domains"), C("text").contains("***").alias("sender_fails"),
    )


def found(t):
    return verdicts.findings(messages(t), "msg_id", "text", PACK)


M = r"""m AS (SELECT doc_id AS msg_id, text, source, coalesce(nullif(regexp_extract(text, '@([a-z0-9]+\.example\.com)', 1), ''), source || '.example.org') AS from_domain,
  contains(text, 'token = ') OR contains(text, 'password=') OR regexp_matches(text, '[0-9]{16}') AS asks, contains(text, 'Licens') AS known_domains, contains(text, '***') AS sender_fails FROM documents)"""
R = r"""r AS (
  SELECT msg_id, 'MONEY' AS chk, 'CARD_NUMBER' AS code, 5 AS severity FROM m WHERE regexp_matches(text, '[0-9]{16}')
  UNION ALL SELECT msg_id, 'MONEY', 'PAY_HOST', 3 FROM m WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')
  UNION ALL SELECT msg_id, 'DELIVERY', 'CREDENTIAL', 4 FROM m WHERE contains(text, 'password=')
  UNION ALL SELECT msg_id, 'CLAIM', 'PRESSURE', 3 FROM m WHERE contains(text, '$$$')
  UNION ALL SELECT msg_id, 'CLAIM', 'SECRET', 4 FROM m WHERE contains(text, 'token = ')
  UNION ALL SELECT msg_id, 'ENTITY', 'PHONE', 2 FROM m WHERE contains(text, '+1 (')
  UNION ALL SELECT msg_id, 'EMAIL_AUTH', 'FREE_MAIL', 3 FROM m WHERE regexp_matches(text, '@mail[0-9]+\.example\.com'))"""
K = r"""k AS (SELECT *, CASE WHEN code = 'CARD_NUMBER' OR (chk IN ('MONEY', 'DELIVERY') AND severity >= 4) THEN 'disqualifying' WHEN severity >= 3 THEN 'weak' ELSE 'note' END AS kind, chk IN ('MONEY', 'DELIVERY') AS mechanism FROM r)"""


def ladder_sql(off: str) -> str:
    """The ladder without one check, in SQL."""
    n = 4 if off else 5
    return f"""SELECT msg_id, raw, CASE WHEN confidence < CASE held WHEN 'FRAUDULENT' THEN 70 WHEN 'TAMPERED' THEN 65 WHEN 'GENUINE' THEN 60 ELSE 0 END THEN 'UNVERIFIED' ELSE held END AS verdict, confidence, n_out, n_weak, passes FROM (
  SELECT *, CASE WHEN held = 'FRAUDULENT' THEN least(100, 55 + 15 * least(n5, 2) + 5 * least(n4, 2) + CASE WHEN mechanism THEN 15 ELSE 0 END) ELSE floor(passes * 100.0 / {n} + 0.5) END::INT AS confidence FROM (
    SELECT *, CASE WHEN raw = 'FRAUDULENT' AND (NOT mechanism OR (NOT value AND known_domains AND NOT pays AND NOT sender_fails)) THEN 'UNVERIFIED' ELSE raw END AS held FROM (
      SELECT *, CASE WHEN n_out > 0 THEN 'FRAUDULENT' WHEN NOT asks THEN CASE WHEN passes >= 2 THEN 'GENUINE' ELSE 'UNVERIFIED' END WHEN n_weak >= 2 THEN 'FRAUDULENT' WHEN passes > n_weak THEN 'GENUINE' ELSE 'UNVERIFIED' END AS raw FROM (
        SELECT m.msg_id, any_value(asks) AS asks, any_value(known_domains) AS known_domains, any_value(sender_fails) AS sender_fails, count(*) FILTER (kind = 'disqualifying')::INT AS n_out, count(*) FILTER (kind = 'weak')::INT AS n_weak,
          count(*) FILTER (severity >= 5) AS n5, count(*) FILTER (severity = 4) AS n4, coalesce(bool_or(mechanism), false) AS mechanism, ({n} - count(DISTINCT CASE WHEN severity >= 3 THEN chk END))::INT AS passes,
          coalesce(bool_or(chk = 'MONEY' AND severity >= 4), false) AS pays, coalesce(bool_or(chk IN ('MONEY', 'DELIVERY') AND severity >= 3), false) AS value
        FROM m LEFT JOIN (SELECT * FROM k WHERE chk <> '{off}') f ON f.msg_id = m.msg_id GROUP BY m.msg_id))))"""


query("r04_claim_findings", f"WITH {M}, {R} SELECT msg_id, chk AS \"check\", code, severity FROM r")(found)
query("a14_classified", f"WITH {M}, {R}, {K} SELECT msg_id, code, kind, mechanism FROM k")(lambda t: verdicts.classified(found(t), OUT, WAYS).select("msg_id", "code", "kind", "mechanism"))
query("a16_judged", f"WITH {M}, {R}, {K} {ladder_sql('')}")(lambda t: verdicts.judged(messages(t), "msg_id", found(t), CHECKS, OUT, WAYS))
query("z56_ablation", f"WITH {M}, {R}, {K} " + " UNION ALL ".join(f"SELECT '{off}' AS off, verdict, count(*) AS n FROM ({ladder_sql(off)}) GROUP BY verdict" for off in ("", *CHECKS)))(
    lambda t: verdicts.without_each(messages(t), "msg_id", found(t), CHECKS, OUT, WAYS))
query("a18_mechanisms", f"WITH {M}, {R}, {K} SELECT msg_id, bool_or(mechanism) AS mechanism, max(severity)::INT AS worst FROM k GROUP BY msg_id")(
    lambda t: verdicts.classified(found(t), OUT, WAYS).groupBy("msg_id").agg(F.max("mechanism").alias("mechanism"), F.max("severity").alias("worst")))
query("a17_countervailing", f"WITH {M}, {R}, {K}, j AS ({ladder_sql('')}) SELECT source, count(*) FILTER (raw = 'FRAUDULENT') AS accused, count(*) FILTER (raw = 'FRAUDULENT' AND verdict <> raw) AS withdrawn FROM j JOIN m USING (msg_id) GROUP BY source")(
    lambda t: verdicts.judged(messages(t), "msg_id", found(t), CHECKS, OUT, WAYS).join(messages(t).select("msg_id", "source"), "msg_id").groupBy("source").agg(F.count_if(C("raw") == "FRAUDULENT").alias("accused"), F.count_if((C("raw") == "FRAUDULENT") & (C("verdict") != C("raw"))).alias("withdrawn")))
query("z41_summary", f"WITH {M}, {R}, {K}, j AS ({ladder_sql('')}), w AS (SELECT msg_id, min_by(code, struct_pack(s := -severity, c := code)) AS top FROM k GROUP BY msg_id) SELECT j.msg_id, CASE WHEN verdict = 'UNVERIFIED' THEN 'not enough to judge' ELSE concat_ws(' ', CASE WHEN confidence >= 85 THEN 'clearly' WHEN confidence >= 70 THEN 'probably' ELSE 'possibly' END, lower(verdict), '(' || coalesce(top, 'nothing found') || ')') END AS line FROM j LEFT JOIN w USING (msg_id)")(
    lambda t: verdicts.judged(messages(t), "msg_id", found(t), CHECKS, OUT, WAYS).join(found(t).groupBy("msg_id").agg(F.min_by("code", F.struct(-C("severity"), C("code"))).alias("top")), "msg_id", "left").select("msg_id", verdicts.summary_line(C("verdict"), C("confidence"), F.coalesce("top", F.lit("nothing found"))).alias("line")))

_SENDER = r"""s AS (SELECT msg_id, from_domain, CASE WHEN contains(text, '***') THEN 'fail' WHEN contains(text, '$$$') THEN 'none' WHEN contains(text, ' | ') THEN NULL ELSE 'pass' END AS dmarc, starts_with(from_domain, 'mail') AS free, source IN ('src1', 'src2', 'src3', 'src4') AS mapped,
  contains(text, 'Licens') AS claims, source IN ('src1', 'src2') AS fits, source || '.example.net' AS reply FROM m)"""


def senders(t):
    body = C("text")
    dmarc = F.when(body.contains("***"), "fail").when(body.contains("$$$"), "none").when(body.contains(" | "), None).otherwise("pass")
    return messages(t).select("msg_id", "from_domain", dmarc.alias("dmarc"), C("from_domain").startswith("mail").alias("free"), C("source").isin("src1", "src2", "src3", "src4").alias("mapped"), body.contains("Licens").alias("claims"), C("source").isin("src1", "src2").alias("fits"), F.concat("source", F.lit(".example.net")).alias("reply"), "asks", body.rlike(r"\n> ").alias("forwarded"))


query("r07_sender_state", f"WITH {M}, {_SENDER} SELECT msg_id, CASE WHEN dmarc = 'fail' THEN 'DMARC_FAIL' WHEN dmarc IS NULL THEN 'NO_AUTHENTICATION_RESULTS' WHEN free THEN 'INSTITUTIONAL_CLAIM_FROM_FREEMAIL' WHEN dmarc = 'pass' AND mapped AND claims AND NOT fits THEN 'ENTITY_DOMAIN_MISMATCH' WHEN dmarc = 'pass' AND mapped THEN 'AUTHENTICATED_RECOGNISED' WHEN dmarc = 'pass' THEN 'AUTHENTICATED_UNRECOGNISED' ELSE 'AUTHENTICATION_INCONCLUSIVE' END AS code, CASE WHEN dmarc = 'fail' THEN 5 WHEN dmarc IS NULL THEN 1 WHEN free THEN 4 WHEN dmarc = 'pass' AND mapped AND claims AND NOT fits THEN 4 WHEN dmarc = 'pass' AND mapped THEN 0 WHEN dmarc = 'pass' THEN 3 ELSE 2 END AS severity FROM s")(
    lambda t: senders(t).select("msg_id", verdicts.sender_state(C("dmarc"), C("free"), C("mapped"), C("claims"), C("fits")).alias("s")).select("msg_id", "s.*"))
query("r08_header_anomalies", f"WITH {M}, {_SENDER} SELECT msg_id, array_to_string(list_filter([CASE WHEN regexp_extract(reply, '([a-z0-9-]+\\.[a-z]+)$', 1) <> regexp_extract(from_domain, '([a-z0-9-]+\\.[a-z]+)$', 1) THEN 'REPLY_TO_MISMATCH' END, CASE WHEN free THEN NULL WHEN regexp_extract(from_domain, '([a-z0-9-]+\\.[a-z]+)$', 1) <> 'example.org' THEN 'RETURN_PATH_MISMATCH' END, CASE WHEN claims AND regexp_extract(from_domain, '([a-z0-9-]+\\.[a-z]+)$', 1) <> 'regulator.com' THEN 'DISPLAY_NAME_DOMAIN_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS codes FROM s")(
    lambda t: senders(t).select("msg_id", F.array_join(verdicts.header_anomalies(urls.plain_registrable, C("from_domain"), C("reply"), F.when(~C("free"), F.lit("bounce.example.org")), F.when(C("claims"), F.lit("Desk of Regulator.com"))), ",").alias("codes")))
query("r09_short_circuit", f"WITH {M}, {_SENDER} SELECT s.msg_id, coalesce(NOT regexp_matches(text, '\\n> ') AND dmarc = 'pass' AND NOT free AND mapped AND NOT asks, false) AS out FROM s JOIN m ON m.msg_id = s.msg_id")(
    lambda t: senders(t).select("msg_id", verdicts.short_circuit(F.lit("EMAIL"), C("forwarded"), F.lit("Pass"), C("dmarc"), ~C("free"), F.when(C("mapped"), C("from_domain")), C("asks")).alias("out")))
query("r12_origin", "SELECT page_id, greatest(CASE WHEN contains(url, '.example.org') THEN 0.0 WHEN contains(url, 'spam-farm') THEN 0.95 ELSE 0.5 END, CASE WHEN contains(url, '/en/') AND NOT contains(url, '.example.org') THEN 0.9 ELSE 0 END)::DOUBLE AS score FROM pages")(
    lambda t: t("pages").select("page_id", verdicts.origin_score(C("url").contains(".example.org"), C("url").contains("spam-farm"), C("url").contains("/en/"), C("url").contains(".example.org"), F.lit(None).cast("boolean")).alias("score")))
query("r13_polarity", "SELECT doc_id, round(CASE WHEN toxic = 1 THEN (doc_id % 50 + 50) / 100.0 ELSE 1 - (doc_id % 50 + 50) / 100.0 END, 6)::DOUBLE AS out FROM labels")(
    lambda t: t("labels").select("doc_id", verdicts.polarity(F.when(C("toxic") == 1, "Phishing").otherwise("benign"), (C("doc_id") % 50 + 50) / 100.0).alias("out")))
query("r14_fake_probability", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.75 WHEN quality = 1 THEN 0.25 END::DOUBLE AS out FROM labels")(
    lambda t: t("labels").select("doc_id", verdicts.fake_probability(F.array(F.struct(F.when(C("toxic") == 1, "fake").when(C("quality") == 1, "real").otherwise("other").alias("name"), F.lit(0.75).alias("confidence")))).alias("out")))
query("r11_chat", r"""WITH c AS (SELECT conv_id, turn, role = 'user' AS outgoing, len(regexp_extract_all(text, '[0-9]{2,}')) AS shared, CASE WHEN contains(text, 'http') THEN 'collision' WHEN turn % 3 = 0 THEN 'absent' WHEN turn % 3 = 1 THEN 'unverified' ELSE 'valid' END AS reg, contains(text, '$') AS pay, contains(text, '.apk') AS app, len(regexp_extract_all(text, '!!')) AS typ, length(text) > 300 AS long_text, contains(text, chr(10)) AS many FROM conversations),
f AS (SELECT *, list_filter([CASE WHEN shared >= 2 THEN 'W6_CAMPAIGN_LINKED' END, CASE WHEN reg = 'collision' THEN 'W5_IDENTITY_MISMATCH' END, CASE WHEN app THEN 'W4_UNSAFE_APP_OFFER' END, CASE WHEN pay THEN 'W4_PAYMENT_SOLICITATION' END, CASE WHEN typ > 0 THEN 'W3_TYPOLOGY_MATCH' END, CASE WHEN reg IN ('absent', 'unverified') THEN 'W2_UNVERIFIED_ADVISORY' END, CASE WHEN long_text AND many THEN 'W1_UNSOLICITED_CONTEXT' END], lambda x: x IS NOT NULL) AS fired FROM c)
SELECT conv_id, turn, CASE WHEN outgoing OR len(fired) = 0 THEN 'W0_NO_SIGNALS' ELSE array_to_string(fired, ',') END AS codes FROM f""")(
    lambda t: t("conversations").select("conv_id", "turn", F.array_join(verdicts.chat_code(C("role") == "user", F.regexp_count("text", F.lit("[0-9]{2,}")), F.when(C("text").contains("http"), "collision").when(C("turn") % 3 == 0, "absent").when(C("turn") % 3 == 1, "unverified").otherwise("valid"), C("text").contains("$"), C("text").contains(".apk"), F.regexp_count("text", F.lit("!!")), F.lit(None).cast("date"), F.to_date(F.lit("2026-05-01")), F.array_compact(F.array(F.when(F.length("text") > 300, "unsolicited_add"), F.when(C("text").contains("\n"), "skewed_poster_ratio"), F.lit("other")))), ",").alias("codes")))

_GROUPS = {"clickbait": ("!!", "Licens"), "emotional": ("(?i)worthless", "(?i)hate"), "urgency": ("password=",), "absolute": ("token = ", "All rights")}
_COUNT = "list_filter([CASE WHEN {a} + {b} > 0 THEN '{g}:' || ({a} + {b}) END], lambda x: x IS NOT NULL)"
query("a27_manipulation_signals", r"""WITH h AS (SELECT doc_id, text, contains(text, '!!')::INT + contains(text, 'Licens')::INT AS clickbait, contains(lower(text), 'worthless')::INT + contains(lower(text), 'hate')::INT AS emotional, contains(text, 'password=')::INT AS urgency, contains(text, 'token = ')::INT + contains(text, 'All rights')::INT AS absolute_,
  CASE WHEN length(text) > 100 THEN (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) / length(text) ELSE 0 END AS caps, length(text) - length(replace(text, '!', '')) AS marks FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN clickbait > 0 THEN 'clickbait:' || clickbait END, CASE WHEN emotional > 0 THEN 'emotional:' || emotional END, CASE WHEN urgency > 0 THEN 'urgency:' || urgency END, CASE WHEN absolute_ > 0 THEN 'absolute:' || absolute_ END, CASE WHEN caps > 0.3 THEN 'capitals:2' WHEN caps > 0.2 THEN 'capitals:1' END, CASE WHEN marks >= 5 THEN 'exclamations:2' WHEN marks >= 3 THEN 'exclamations:1' END], lambda x: x IS NOT NULL), ',') AS signs FROM h""")(
    lambda t: t("documents").select("doc_id", F.array_join(verdicts.manipulation_signals(C("text"), _GROUPS), ",").alias("signs")))
query("a28_manipulation_score", r"""WITH h AS (SELECT doc_id, contains(text, 'password=')::INT AS a, contains(text, 'token = ')::INT AS b, contains(text, '$$$')::INT AS c, regexp_matches(text, '\+1 \(')::INT AS d, contains(text, '###')::INT AS e FROM documents)
SELECT doc_id, least(100, 25 * a + 20 * b + 8 * c + 6 * d + 4 * e + CASE WHEN greatest(a, b) + greatest(c, e) + d >= 3 THEN 10 WHEN greatest(a, b) + greatest(c, e) + d >= 2 THEN 5 ELSE 0 END)::INT AS score, (a + b + c + d + e)::INT AS patterns FROM h""")(
    lambda t: t("documents").select("doc_id", verdicts.manipulation_score(C("text"), [("password=", "theft", True, 20), ("token = ", "theft", True, 15), (r"\$\$\$", "noise", False, 8), (r"\+1 \(", "contact", False, 6), ("###", "noise", False, 4)]).alias("s")).select("doc_id", "s.*"))
query("a30_typologies", r"""WITH h AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'password=[0-9a-f]+') THEN 'pattern' WHEN contains(lower(text), 'password') THEN 'keyword' END AS a, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'pattern' WHEN contains(lower(text), 'card') THEN 'keyword' END AS b, CASE WHEN regexp_matches(text, '\$\$\$') THEN 'pattern' WHEN contains(lower(text), 'licens') THEN 'keyword' END AS c FROM documents)
SELECT doc_id, array_to_string(list_filter(['credential:' || a, 'card:' || b, 'noise:' || c], lambda x: x IS NOT NULL), ',') AS matched, (CASE WHEN a IS NULL THEN 0 ELSE 30 END + CASE WHEN b IS NULL THEN 0 ELSE 20 END + CASE WHEN c IS NULL THEN 0 ELSE 10 END)::INT AS penalty FROM h""")(
    lambda t: t("documents").select("doc_id", verdicts.typologies(C("text"), [("noise", 10, r"\$\$\$", ("licens",)), ("credential", 30, "password=[0-9a-f]+", ("password",)), ("card", 20, "[0-9]{16}", ("card",))]).alias("x")).select("doc_id", F.array_join("x.matched", ",").alias("matched"), "x.penalty"))
query("a24_merged_layers", "WITH h AS (SELECT doc_id, CASE WHEN contains(text, '$$$') THEN 60 ELSE 20 END AS l0, CASE WHEN contains(text, 'password=') THEN 40 END AS l1, CASE WHEN contains(text, 'token = ') THEN 90 END AS l2 FROM documents), b AS (SELECT doc_id, CASE WHEN l1 IS NULL THEN least(l0, 35) ELSE l0 END + coalesce(l1, 0) AS base, l2 FROM h), s AS (SELECT doc_id, greatest(0, least(100, CASE WHEN l2 IS NULL THEN base ELSE floor((base + 2 * l2) / 3 + 0.5) END))::INT AS score FROM b) SELECT doc_id, score, CASE WHEN score >= 75 THEN 'scam' WHEN score >= 45 THEN 'suspicious' ELSE 'safe' END AS level FROM s")(
    lambda t: t("documents").select("doc_id", verdicts.merged_layers(F.when(C("text").contains("$$$"), 60).otherwise(20), F.when(C("text").contains("password="), 40), F.when(C("text").contains("token = "), 90), F.lit(True)).alias("x")).select("doc_id", "x.*"))
_KINDS = ("(?i)signup", "(?i)view", "(?i)error", "(?i)purchase")
query("t07_signal_kind", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'protective' WHEN 'view' THEN 'context' ELSE 'risk' END AS polarity, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'none' END AS severity FROM events")(
    lambda t: t("events").select("event_id", verdicts.signal_kind(F.concat(F.lit("[error] "), "event_type"), *_KINDS).alias("k")).select("event_id", "k.*"))
query("t06_signal_partition", """WITH e AS (SELECT user_id, event_type AS label, CASE event_type WHEN 'signup' THEN 'protective' WHEN 'view' THEN 'context' ELSE 'risk' END AS polarity, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rank FROM (SELECT DISTINCT user_id, event_type FROM events))
SELECT user_id, coalesce(string_agg(label, ',' ORDER BY rank, label) FILTER (polarity = 'risk'), '') AS risk, coalesce(string_agg(label, ',') FILTER (polarity = 'protective'), '') AS protective, coalesce(string_agg(label, ',') FILTER (polarity = 'context'), '') AS context FROM e GROUP BY user_id""")(
    lambda t: t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")).select("user_id", verdicts.partitioned(F.transform("kinds", lambda x: F.struct(x.alias("label"), verdicts.signal_kind(x, *_KINDS).polarity.alias("polarity"), verdicts.signal_kind(x, *_KINDS).severity.alias("severity")))).alias("p")).select("user_id", *[F.array_join(f"p.{k}", ",").alias(k) for k in ("risk", "protective", "context")]))
query("t09_distinct_first", r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM documents), f AS (SELECT doc_id, arg_min(word, place) AS word, min(place) AS place FROM w GROUP BY doc_id, lower(word)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM f) SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words FROM n WHERE k <= 5 GROUP BY doc_id""")(
    lambda t: t("documents").filter("text is not null").select("doc_id", F.array_join(verdicts.distinct_first(F.split("text", " ")), " ").alias("words")))


def paying(t):
    k = C("c_custkey")
    at = F.element_at(F.array(*map(F.lit, ("pay to ab{}@OkBank now. ", "pay to ab{}@wallet now. ", "pay to ab{}@nobank now. ", "hello. "))), (k % 4 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ("IFSC HDFC0{} ", "IFSC ZZZZ0{} ", "no code "))), (k % 3 + 1).cast("int"))
    body = F.concat(F.replace(at, F.lit("{}"), k.cast("string")), F.replace(code, F.lit("{}"), F.lpad(k.cast("string"), 6, "0")), F.when(k % 5 == 0, F.concat(F.lit("transfer to account 5000"), F.lpad(k.cast("string"), 8, "0"))).otherwise(""), F.when(k % 7 == 0, " upi://pay?x").otherwise(""))
    return t("customer").select("c_custkey", body.alias("body"), F.when(k % 2 == 0, "Zen Bank Ltd").otherwise("HDFC").alias("claimed"), C("c_mktsegment").isin("BUILDING", "MACHINERY").alias("investing"))


query("r03_money", """WITH m AS (SELECT c_custkey, c_custkey AS k, c_mktsegment IN ('BUILDING', 'MACHINERY') AS i FROM customer)
SELECT c_custkey, CASE k % 4 WHEN 0 THEN 'UPI_BANK' WHEN 1 THEN 'UPI_WALLET' ELSE 'UPI_UNKNOWN_HANDLE' END AS code, CASE WHEN NOT i THEN 2 ELSE CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END END AS severity, 'ab' || k || ['@OkBank', '@wallet', '@nobank'][(k % 4 + 1)::INT] AS evidence FROM m WHERE k % 4 < 3
UNION ALL SELECT c_custkey, CASE k % 3 WHEN 0 THEN 'IFSC_BANK_MISMATCH' ELSE 'IFSC_UNKNOWN_BANK' END, CASE k % 3 WHEN 0 THEN 4 ELSE 2 END, CASE k % 3 WHEN 0 THEN 'HDFC0' ELSE 'ZZZZ0' END || lpad(k::VARCHAR, 6, '0') FROM m WHERE k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 0)
UNION ALL SELECT c_custkey, 'ACCOUNT_SOLICITATION', CASE WHEN i THEN 4 ELSE 3 END, '5000' || lpad(k::VARCHAR, 8, '0') FROM m WHERE k % 5 = 0
UNION ALL SELECT c_custkey, 'PAYMENT_LINK', CASE WHEN i THEN 4 ELSE 3 END, 'upi://pay' FROM m WHERE k % 7 = 0""")(
    lambda t: chokepoints.money(paying(t), "c_custkey", "body", "claimed", t.spark.createDataFrame([("okbank", "bank", 1), ("wallet", "wallet", 4)], "suffix string, category string, severity int"), t.spark.createDataFrame([("HDFC", "HDFC Bank")], "prefix string, bank string"), C("investing")).drop("check"))
query("r05_delivery", r"""WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_extract(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1)), '([^.]+\.[^.]+)$', 1) AS d FROM pages)
SELECT page_id, 'SHORTENED_LINK' AS code, 3 AS severity, 'bit.ly' AS evidence FROM p WHERE k = 0 UNION ALL SELECT page_id, 'LOOKALIKE_DOMAIN', 5, 'examp1e.top' FROM p WHERE k = 1 UNION ALL SELECT page_id, 'RISKY_ENDING', 3, 'examp1e.top' FROM p WHERE k = 1
UNION ALL SELECT page_id, 'APK_LINK', 5, 'example.net' FROM p WHERE k = 2 UNION ALL SELECT page_id, 'NEW_DOMAIN', 4, 'example.net' FROM p WHERE k = 2 UNION ALL SELECT page_id, 'PUNYCODE_HOST', 4, 'xn--bcher-kva.zip' FROM p WHERE k = 3 UNION ALL SELECT page_id, 'RISKY_ENDING', 3, 'xn--bcher-kva.zip' FROM p WHERE k = 3
UNION ALL SELECT page_id, 'KNOWN_OFFICIAL_DOMAIN', 0, d FROM p WHERE k > 3 AND d = 'example.com' UNION ALL SELECT page_id, 'NEW_DOMAIN', 4, d FROM p WHERE k > 3 AND d = 'example.net'""")(
    lambda t: chokepoints.delivery(t("pages").select("page_id", F.when(C("page_id") % 6 == 0, "https://bit.ly/x").when(C("page_id") % 6 == 1, "https://examp1e.top/a").when(C("page_id") % 6 == 2, "https://cdn.example.net/app.apk").when(C("page_id") % 6 == 3, "http://xn--bcher-kva.zip/").otherwise(C("url")).alias("url")), "page_id", "url", t.spark.createDataFrame([("example.com", "COM")], "domain string, entity string"), t.spark.createDataFrame([("example.net", 30), ("example.org", 400)], "domain string, days int"), ("example",)).drop("check"))
query("r06_entity", """WITH c AS (SELECT o_orderkey, 'INZ' || lpad((o_custkey % 160)::VARCHAR, 9, '0') AS number, o_custkey % 160 AS n, CASE o_orderkey % 3 WHEN 0 THEN 'supplier ' || lpad((o_custkey % 160)::VARCHAR, 9, '0') WHEN 1 THEN 'supplier' ELSE 'customer 7' END AS said, o_orderstatus FROM orders),
s AS (SELECT o_orderkey, number, CASE WHEN s_suppkey IS NULL THEN 'ABSENT' WHEN s_acctbal <= 0 THEN 'UNVERIFIED' WHEN said = 'supplier ' || lpad(n::VARCHAR, 9, '0') THEN 'VALID' WHEN said = 'supplier' THEN 'WEAK_MATCH' ELSE 'COLLISION' END AS state FROM c LEFT JOIN supplier ON s_suppkey = n WHERE o_orderstatus <> 'P')
SELECT o_orderkey, 'REGISTRATION_' || state AS code, CASE state WHEN 'COLLISION' THEN 5 WHEN 'ABSENT' THEN 4 WHEN 'WEAK_MATCH' THEN 2 WHEN 'UNVERIFIED' THEN 3 ELSE 0 END AS severity, number AS evidence FROM s UNION ALL SELECT o_orderkey, 'ISIN_INVALID', 4, 'INE002A01017' FROM orders WHERE o_orderkey % 4 = 1""")(
    lambda t: chokepoints.entity(t("orders").select("o_orderkey", F.concat(F.when(C("o_orderstatus") == "P", "no number").otherwise(F.concat(F.lit("Regd. INZ"), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0"))), F.when(C("o_orderkey") % 4 == 0, " INE002A01018").when(C("o_orderkey") % 4 == 1, " INE002A01017").otherwise("")).alias("body"), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("Supplier "), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0"), F.lit(" Pvt Ltd"))).when(C("o_orderkey") % 3 == 1, "Supplier Limited").otherwise("Customer 7").alias("said")), "o_orderkey", "body", "said", t("supplier").select(F.concat(F.lit("INZ"), F.lpad(C("s_suppkey").cast("string"), 9, "0")).alias("number"), C("s_name").alias("name"), (C("s_acctbal") > 0).alias("active"))).drop("check"))
query("r17_preview", f"WITH {M}, {R}, {K}, c AS (SELECT m.msg_id, any_value(asks) AS asks, count(*) FILTER (kind = 'disqualifying') AS o, count(*) FILTER (kind = 'weak') AS w FROM m LEFT JOIN k USING (msg_id) GROUP BY m.msg_id) SELECT msg_id, CASE WHEN o >= 1 OR (w >= 2 AND asks) THEN 'stop' WHEN w >= 1 THEN 'caution' ELSE 'ok' END AS out FROM c")(
    lambda t: verdicts.counted(messages(t), "msg_id", verdicts.classified(found(t), OUT, WAYS)).select("msg_id", verdicts.preview(C("n_out"), C("n_weak"), C("asks")).alias("out")))
query("r16_quick_check", """WITH c AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN s_suppkey IS NULL THEN 'absent' WHEN s_acctbal <= 0 THEN 'unverified' WHEN o_orderkey % 3 = 0 THEN 'valid' WHEN o_orderkey % 3 = 1 THEN 'weak_match' ELSE 'collision' END AS state FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 160 AND o_orderstatus <> 'P'), w AS (SELECT o_custkey, arg_min(state, list_position(['collision', 'invalid', 'absent', 'weak_match', 'unverified', 'not_applicable', 'valid'], state)) AS state FROM c GROUP BY 1)
SELECT o_custkey, state, CASE state WHEN 'collision' THEN -45 WHEN 'invalid' THEN -40 WHEN 'absent' THEN -20 WHEN 'weak_match' THEN -10 WHEN 'valid' THEN 25 ELSE 0 END AS delta FROM w""")(
    lambda t: scoring.worst_state(registers.by_number(t("orders").select("o_custkey", F.concat(F.when(C("o_orderstatus") == "P", "XX").otherwise("INZ"), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0")).alias("number"), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("Supplier "), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0"))).when(C("o_orderkey") % 3 == 1, "Supplier Limited").otherwise("Customer 7").alias("said")), "number", t("supplier").select(F.concat(F.lit("INZ"), F.lpad(C("s_suppkey").cast("string"), 9, "0")).alias("no"), "s_name", (C("s_acctbal") > 0).alias("active")), "no", "s_name", "active", "said"), "o_custkey", "state"))
query("k11_contracts", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'tampered' WHEN 2 THEN 'revoked' ELSE 'valid' END AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", verdicts.signed_state(C("c_name"), F.when(C("c_custkey") % 4 == 1, text.keyed_digest(F.lit("other"), b"key")).when(C("c_custkey") % 4 > 1, text.keyed_digest(C("c_name"), b"key")), "key", text.keyed_digest, C("c_custkey") % 4 == 2).alias("out")))
query("x25_forward", r"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ATTACHED' WHEN 1 THEN 'INLINE' ELSE 'DIRECT' END AS kind, CASE WHEN c_custkey % 3 < 2 THEN 'u' || c_custkey || '@mail.example' END AS sender, CASE WHEN c_custkey % 3 < 2 THEN 'Re: ' || c_name END AS subject FROM customer""")(
    lambda t: t("customer").select("c_custkey", entities.forwarded(F.concat(F.lit("see below\n"), F.when(C("c_custkey") % 3 == 1, "---------- Forwarded message ---------\n").otherwise(""), F.lit("> From: Some One <U"), C("c_custkey").cast("string"), F.lit("@mail.Example>\n> Subject: Re: "), "c_name", F.lit("\nhello")), C("c_custkey") % 3 == 0).alias("f")).select("c_custkey", "f.*"))
query("x01_fields", r"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b[0-9]{9,18}\b')), lambda x: NOT list_contains(list_distinct(regexp_extract_all(text, '(?:\+91[-\s]?)?0?([6-9]\d{9})\b', 1)), x) AND NOT list_contains(list_transform(regexp_extract_all(text, '\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b'), lambda y: regexp_replace(y, '\s', '', 'g')), x))), ',') AS accounts, len(list_distinct(regexp_extract_all(text, 'https?://[^\s\)\]\}<>\x22'']+')))::INT AS urls FROM documents""")(
    lambda t: t("documents").select("doc_id", entities.fields(C("text")).alias("f")).select("doc_id", F.array_join(F.array_sort("f.accounts"), ",").alias("accounts"), F.size("f.urls").alias("urls")))
query("x13_campaign_entities", r"SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '(?:^|[^\w@])@([A-Za-z0-9_]{3,30})\b', 1)))::INT AS handles FROM conversations")(
    lambda t: t("conversations").select("conv_id", "turn", F.size(F.filter(entities.campaign_entities(C("text")), lambda e: e["type"] == "handle")).alias("handles")))
query("p09_retention_on_write", "WITH u AS (SELECT event_id, ts FROM events WHERE event_id % 3 < 2 UNION SELECT event_id, ts FROM events WHERE event_id % 3 > 0) SELECT event_id FROM u WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY ORDER BY event_id DESC LIMIT 500")(
    lambda t: rollups.retain(rollups.insert_new(*[t("events").filter(p).select(C("event_id").cast("string").alias("id"), "event_id", "ts") for p in ("event_id % 3 < 2", "event_id % 3 > 0")], "id").join(t("events").agg(F.max("ts").alias("now"))), "ts", "event_id", C("now"), 5, 500).select("event_id"))
