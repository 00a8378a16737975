"""Queries of messages: routing, requests, contacts, reports, scripts, records and packs that are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veriloom.functions import entities, text, urls
from veriloom.operators import features, lookups, messages, registers, rules
from veriloom.plans.base import query
from veriloom.plans.scalars import HOST
from veriloom.sources import readers
from veriloom.sources.shared import land, shared_dir

C = F.col

query("f02_solicits_value", rf"""SELECT doc_id, regexp_matches(regexp_replace(left(text, 20000), '{messages.ADVICE.replace("'", "''")}', ' ', 'g'), '{messages.SOLICITS}') AS out FROM documents
UNION ALL SELECT -1 - conv_id * 1000 - turn, regexp_matches(regexp_replace(t, '{messages.ADVICE.replace("'", "''")}', ' ', 'g'), '{messages.SOLICITS}') FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Never share your OTP. ' WHEN 1 THEN 'Please share the OTP now. ' WHEN 2 THEN 'We will never ask you to pay a fee. Processing fee due. ' ELSE '' END || left(text, 200) AS t FROM conversations)""")(
    lambda t: t("documents").select("doc_id", messages.solicits_value(C("text")).alias("out")).unionByName(t("conversations").select((-1 - C("conv_id") * 1000 - C("turn")).alias("doc_id"), messages.solicits_value(F.concat(F.when(C("turn") % 4 == 0, "Never share your OTP. ").when(C("turn") % 4 == 1, "Please share the OTP now. ").when(C("turn") % 4 == 2, "We will never ask you to pay a fee. Processing fee due. ").otherwise(""), F.left("text", F.lit(200)))).alias("out"))))


def _inputs(t):
    """Pages as they may come in: as mail with the title as its subject, as a URL, as HTML, or as a picture."""
    host, title = urls.host(C("url")), F.regexp_replace(F.regexp_extract("html", "(?s)<title>([^<]*)", 1), "[^ -~]", "")
    mail = F.concat(F.lit("From: Desk <desk@"), host, F.lit(">\nSubject: "), title, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nSee "), C("url"), F.lit(" now\n"))
    k = C("page_id") % 4
    return t("pages").select("page_id", F.encode(F.when(k == 0, mail).when(k == 1, F.concat(F.lit(" "), C("url"), F.lit("\n"))).when(k == 2, C("html")).otherwise("GIF89a...."), "UTF-8").alias("data"), F.lit(None).cast("string").alias("name"))


query("s15_route", rf"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'URL' WHEN 2 THEN 'TEXT' ELSE 'IMAGE' END AS source_type, CASE page_id % 4 WHEN 0 THEN 'See ' || url || ' now' || chr(10) WHEN 1 THEN url WHEN 2 THEN html ELSE '' END AS body, CASE WHEN page_id % 4 = 0 THEN trim(regexp_replace(regexp_extract(html, '(?s)<title>([^<]*)', 1), '[^ -~]', '', 'g')) END AS subject,
CASE WHEN page_id % 4 = 0 THEN 'desk@' || {HOST} END AS sender, CASE WHEN page_id % 4 = 3 THEN 'image_reader_unavailable' END AS error, page_id % 4 IN (0, 1) AS linked FROM pages""")(
    lambda t: messages.routed(_inputs(t), "page_id", "data", "name").select("page_id", "source_type", "body", F.trim("subject").alias("subject"), "sender", "error", (C("source_type").isin("EMAIL", "URL") & (F.size("urls") == 1)).alias("linked")))
query("u27_verify_domain", f"WITH h AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, h = 'example.org' OR h LIKE '%.example.org' AS is_listed, h LIKE '%example.net' AND h <> 'example.net' AS imitates FROM h")(
    lambda t: messages.verified_domain(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", t("pages").select(urls.registrable(urls.host(C("url"))).alias("domain")).filter("domain like '%.org'"), ("example.net",)).select("page_id", "is_listed", "imitates"))


def _entities(t):
    k = C("c_custkey")
    return t("customer").select(F.concat(F.lit("Firm "), F.lpad(k.cast("string"), 7, "0"), F.lit(" Capital")).alias("name"), F.when(k % 5 > 0, F.concat(F.lit("firm"), k.cast("string"), F.lit(".example"))).alias("domains"), F.when(k % 2 == 0, F.concat(F.lit("desk@firm"), k.cast("string"), F.lit(".example"))).alias("contact"), F.when(k % 7 > 0, F.concat(F.lit("INZ"), k.cast("string"))).alias("reg_no"))


query("j25_official_contact", """WITH e AS (SELECT c_custkey AS k, 'Firm ' || lpad(c_custkey::VARCHAR, 7, '0') || ' Capital' AS name FROM customer),
c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'FIRM ' || lpad(s_suppkey::VARCHAR, 7, '0') || ' Capital Pvt Ltd' WHEN 1 THEN lpad(s_suppkey::VARCHAR, 4, '0') ELSE 'zz' || s_suppkey END AS n FROM supplier),
m AS (SELECT s_suppkey, k, name, CASE WHEN s_suppkey % 3 = 0 THEN 'exact' ELSE 'within' END AS by FROM c JOIN e ON CASE WHEN s_suppkey % 3 = 0 THEN lower(name) || ' pvt ltd' = lower(n) ELSE contains(lower(name), n) END)
SELECT s_suppkey, name, CASE WHEN k % 5 > 0 THEN 'firm' || k || '.example' END AS domains, CASE WHEN k % 2 = 0 THEN 'desk@firm' || k || '.example' END AS contact, CASE WHEN k % 7 > 0 THEN 'INZ' || k END AS reg_no, "by" FROM m QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY name) = 1""")(
    lambda t: messages.official_contact(t("supplier").select("s_suppkey", F.when(C("s_suppkey") % 3 == 0, F.concat(F.lit("FIRM "), F.lpad(C("s_suppkey").cast("string"), 7, "0"), F.lit(" Capital Pvt Ltd"))).when(C("s_suppkey") % 3 == 1, F.lpad(C("s_suppkey").cast("string"), 4, "0")).otherwise(F.concat(F.lit("zz"), C("s_suppkey").cast("string"))).alias("n")), "s_suppkey", "n", _entities(t)))


def _t11(t):
    d = t("documents").select(C("doc_id").alias("k"), "text", "source")
    verdicts = d.select("k", F.when(C("text").contains("$$$"), "FRAUDULENT").otherwise("UNVERIFIED").alias("verdict"), (C("k") % 101).alias("confidence"), F.concat(F.lit("Seen in "), F.coalesce("source", F.lit("?"))).alias("summary"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.when(C("k") % 2 == 0, C("source")).alias("entity"), F.when(C("k") % 3 == 0, C("source")).alias("sender"))
    marks = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("severity"), F.lit(f"M{i}").alias("code"), F.lit(m).alias("message")) for i, (s, m) in enumerate(((5, "$$$"), (3, "the"), (4, "@"), (4, "#"), (5, "%"), (4, "|"), (4, "!"), (4, ".")))])
    reasons = d.select("k", F.explode(F.filter(marks, lambda x: F.contains(C("text"), x["message"]))).alias("r")).select("k", "r.*")
    return messages.reports(verdicts, reasons, d.filter("k % 4 = 0"), "k").select(C("k").alias("doc_id"), "route", "body")


query("t11_reports", """WITH m(ord, severity, message) AS (VALUES (0, 5, '$$$'), (1, 3, 'the'), (2, 4, '@'), (3, 4, '#'), (4, 5, '%'), (5, 4, '|'), (6, 4, '!'), (7, 4, '.')),
r AS (SELECT doc_id, ord, '  - [' || severity || '] M' || ord || ': ' || message AS line FROM documents JOIN m ON contains(text, message) WHERE severity >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 6),
l AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS lines FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN contains(text, '$$$') AND doc_id % 4 = 0 THEN 'supervisor' ELSE 'takedown' END AS route, 'Report of suspected fraud: ' || CASE WHEN contains(text, '$$$') THEN 'FRAUDULENT' ELSE 'UNVERIFIED' END || ' (evidence ' || doc_id % 101 || '/100)' || chr(10) || 'Content (SHA-256): ' || sha256(coalesce(text, '')) || chr(10) || 'Claims to be: ' || CASE WHEN doc_id % 2 = 0 THEN coalesce(source, 'not stated') ELSE 'not stated' END || chr(10) || 'Sent by: ' || CASE WHEN doc_id % 3 = 0 THEN coalesce(source, 'unknown') ELSE 'unknown' END || chr(10) || 'Findings:' || chr(10) || coalesce(lines, '  - none of high severity') || chr(10) || 'Summary: Seen in ' || coalesce(source, '?') AS body FROM documents LEFT JOIN l USING (doc_id)""")(_t11)
query("k04_analyses", """SELECT 'text' AS kind, doc_id % 100 AS risk_score, CASE WHEN doc_id % 100 >= 80 THEN 'High' ELSE 'Low' END AS band, 'Document ' || doc_id AS headline, '' AS claimed_issuer, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'T' || doc_id % 7 || ',' || 'U' END AS tickers, coalesce(source, '') AS source,
'{"band":"' || CASE WHEN doc_id % 100 >= 80 THEN 'High' ELSE 'Low' END || '","headline":"Document ' || doc_id || '","kind":"text","score":' || doc_id % 100 || ',"tickers":' || CASE WHEN doc_id % 3 = 0 THEN '[]' ELSE '["T' || doc_id % 7 || '","U"]' END || '}' AS verdict_json FROM documents""")(
    lambda t: messages.analysis_rows(t("documents").select(F.lit("text").alias("kind"), (C("doc_id") % 100).alias("score"), F.when(C("doc_id") % 100 >= 80, "High").otherwise("Low").alias("band"), F.concat(F.lit("Document "), C("doc_id").cast("string")).alias("headline"), F.lit(None).cast("string").alias("issuer"), F.when(C("doc_id") % 3 > 0, F.array(F.concat(F.lit("T"), (C("doc_id") % 7).cast("string")), F.lit("U"))).alias("tickers"), "source")))
query("z27_feed_flagged", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN false WHEN 3 THEN round(value)::INT > 10 WHEN 5 THEN false ELSE value > 20 END AS out FROM events")(
    lambda t: t("events").select("event_id", messages.feed_flagged(F.element_at(F.array(*map(F.lit, ("urlhaus_url", "phishtank", "google_safe_browsing", "virustotal", "ipqualityscore", "other"))), (C("event_id") % 6 + 1).cast("int")),
        F.when(C("event_id") % 6 == 0, F.concat(F.lit('{"listed":'), (C("value") > 20).cast("string"), F.lit("}"))).when(C("event_id") % 6 == 1, F.concat(F.lit('{"is_phish":'), (C("value") > 20).cast("string"), F.lit("}"))).when(C("event_id") % 6 == 2, '{"is_threat":null}').when(C("event_id") % 6 == 3, F.concat(F.lit('{"score":'), (F.round("value").cast("int") / 100).cast("string"), F.lit("}"))).when(C("event_id") % 6 == 4, F.concat(F.lit('{"unsafe":false,"malware":'), (C("value") > 20).cast("string"), F.lit("}"))).otherwise('{"listed":true')).alias("out")))


def _senders(t):
    h = urls.host(C("url"))
    k = C("page_id") % 3
    return t("pages").select("page_id", F.when(k == 0, F.concat(F.lit('"Desk '), C("page_id").cast("string"), F.lit('" <a@'), h, F.lit(">"))).when(k == 1, F.concat(F.lit("a@"), F.upper(h))).otherwise(F.concat(F.lit("<b@"), h, F.lit(">"))).alias("sender"), F.concat(F.lit("from the "), F.when(C("page_id") % 2 == 0, "red widget").otherwise("nobody"), F.lit(" maker")).alias("body"))


query("z35_address_domain", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Desk ' || page_id END AS display, regexp_replace({HOST}, '^www\\.', '') AS domain FROM pages")(
    lambda t: _senders(t).select("page_id", messages.address(C("sender")).alias("a")).select("page_id", "a.display", "a.domain"))
query("z33_forwarded_entity", f"""WITH h AS (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS h FROM pages), o AS (SELECT h, 'Owner ' || min(page_id) AS entity FROM h WHERE h LIKE '%.org' GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Desk ' || page_id WHEN o.entity IS NOT NULL THEN o.entity WHEN page_id % 2 = 0 THEN 'red widget' END AS entity, CASE WHEN page_id % 3 = 0 THEN 'display' WHEN o.entity IS NOT NULL THEN 'domain' WHEN page_id % 2 = 0 THEN 'text' END AS by FROM h LEFT JOIN o USING (h)""")(
    lambda t: messages.forwarded_entity(_senders(t), "page_id", "sender", "body", t("pages").select(F.regexp_replace(urls.host(C("url")), r"^www\.", "").alias("domain"), "page_id").filter("domain like '%.org'").groupBy("domain").agg(F.concat(F.lit("Owner "), F.min("page_id").cast("string")).alias("entity")), t("part").select(C("p_name").alias("name"), C("p_name").alias("normalised")).distinct()))

_LINES = [
    ("en", "opening", "I need help with a message that may be a scam."), ("en", "close", "Please tell me where to report it."), ("en", "fact:error", "A payment went wrong after {brand} wrote to me."), ("en", "fact:*", "Someone writes as {brand}."), ("en", "fact:guardian", "Someone in my family may act on what {brand} wrote."),
    ("en", "ask:lost", "Money may be gone: what is the fastest step, by {first}?"), ("en", "ask:two", "What is the safest step, by {first}, then {second}?"), ("en", "ask:one", "What is the safest step, by {first}?"),
    ("fr", "opening", "Un message est peut-être une fraude."), ("fr", "close", "Où le signaler ?"), ("fr", "fact:*", "On écrit au nom de {brand}."), ("fr", "ask:lost", "L'argent est peut-être parti : que faire d'abord par {first} ?"), ("fr", "ask:two", "Que faire par {first}, puis {second} ?"), ("fr", "ask:one", "Que faire par {first} ?"),
]


def _z49(t):
    cases = t("events").select("event_id", F.when(C("event_id") % 3 == 0, "fr").when(C("event_id") % 3 == 1, "en").otherwise("xx").alias("language"), C("event_type").alias("incident"), F.when(C("event_id") % 5 == 0, "guardian").alias("mode"), (C("value") > 20).alias("lost_money"), F.when(C("user_id") % 2 == 0, F.concat(F.lit("user "), C("user_id").cast("string"))).alias("brand"), F.when(C("event_id") % 4 == 0, F.array(F.lit("bank"))).when(C("event_id") % 4 == 1, F.array(F.lit("bank"), F.lit("police"))).otherwise(F.array().cast("array<string>")).alias("rails"))
    return messages.support_script(cases, "event_id", t.spark.createDataFrame(_LINES, "language string, slot string, template string"), "brand", "rails")


_VALUES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _LINES)
query("z49_support_script", f"""WITH l(language, slot, template) AS (VALUES {_VALUES}), c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fr' ELSE 'en' END AS lang, event_type, event_id % 5 = 0 AS guardian, value > 20 AS lost, CASE WHEN user_id % 2 = 0 THEN 'user ' || user_id ELSE 'the sender' END AS brand, CASE WHEN event_id % 4 < 2 THEN 'bank' ELSE 'the official office' END AS first, CASE WHEN event_id % 4 = 1 THEN 'police' END AS second FROM events),
s AS (SELECT c.*, coalesce((SELECT template FROM l WHERE language = lang AND guardian AND slot = 'fact:guardian'), (SELECT template FROM l WHERE language = lang AND slot = 'fact:' || event_type), (SELECT template FROM l WHERE language = lang AND slot = 'fact:*')) AS fact, (SELECT template FROM l WHERE language = lang AND slot = 'opening') AS opening, (SELECT template FROM l WHERE language = lang AND slot = 'close') AS closing, (SELECT template FROM l WHERE language = lang AND slot = CASE WHEN lost THEN 'ask:lost' WHEN second IS NOT NULL THEN 'ask:two' ELSE 'ask:one' END) AS ask FROM c)
SELECT event_id, replace(replace(replace(opening || chr(10) || fact || chr(10) || ask || chr(10) || closing, '{{brand}}', brand), '{{first}}', first), '{{second}}', coalesce(second, '')) AS script FROM s""")(_z49)


def _channel(c):
    return F.concat_ws(" ", F.when(C("doc_id") % 3 == 0, "Stock Tips").when(C("doc_id") % 3 == 1, "VIP group").otherwise("Family"), c)


query("z18_funnel_name", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'stock' ELSE '' END AS tuned, CASE doc_id % 3 WHEN 0 THEN 'stock,tips' WHEN 1 THEN 'group,vip' ELSE '' END AS broad FROM documents")(
    lambda t: t("documents").select("doc_id", *[F.array_join(messages.funnel_name(_channel(C("lang")), wide), ",").alias(n) for n, wide in (("tuned", False), ("broad", True))]))
query("z55_negative_control", "WITH d AS (SELECT source, doc_id, contains(text, '$$$') AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1), e AS (SELECT source, 'tuned' AS mode, doc_id % 3 = 0 AS hit, s FROM d UNION ALL SELECT source, 'broad', doc_id % 3 < 2, s FROM d) SELECT source, mode, count(*) AS n, count(*) FILTER (hit) AS fired, count(*) FILTER (hit AND s) AS accused FROM e GROUP BY ALL")(
    lambda t: messages.negative_control(t("documents").join(t("labels"), "doc_id").filter("quality = 1").withColumn("name", _channel(C("lang"))), "source", "name", C("text").contains("$$$")))

# --- operators that had no query of their own

query("x14_chat_entities", r"SELECT conv_id, turn, array_to_string(list_distinct(list_transform(regexp_extract_all(text, 'https?://[^\s\)\]\}<>\"'']+'), lambda u: regexp_replace(u, '[.,;)]+$', ''))), ',') AS urls, 0 AS n_ifsc FROM conversations")(
    lambda t: t("conversations").select("conv_id", "turn", entities.chat_entities(C("text")).alias("e")).select("conv_id", "turn", F.array_join("e.urls", ",").alias("urls"), F.size("e.ifsc").alias("n_ifsc")))
query("m06_set_ratio")(lambda t: t("part").select("p_partkey", F.round(lookups.set_ratio(C("p_name"), F.lower("p_type")), 4).alias("score")))
query("u29_lookup_domain", f"WITH h AS (SELECT page_id, {HOST} AS h FROM pages), l AS (SELECT DISTINCT regexp_extract(h, '[^.]+\\.[^.]+$') AS d FROM h WHERE page_id % 2 = 0) SELECT page_id, d AS matched FROM h JOIN l ON h = d OR h LIKE '%.' || d")(
    lambda t: lookups.by_suffix(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", t("pages").filter("page_id % 2 = 0").select(F.regexp_extract(urls.host(C("url")), r"[^.]+\.[^.]+$", 0).alias("host")).distinct()).select("page_id", "matched"))


def _pack(t):
    """A rule a brand, as a pack of rules that was landed as CSV: every fifth without an entity, which is left out."""
    brand = t("part").select(F.lower(F.regexp_replace("p_brand", "#", " ")).alias("b")).distinct()
    n = F.regexp_extract("b", r"(\d+)", 1).cast("int")
    return land(brand.select(F.concat(F.lit("R"), n.cast("string")).alias("id"), F.when(n % 5 > 0, C("b")).otherwise("").alias("entity"), F.when(n % 2 == 0, "buy").otherwise("").alias("action"), F.lit("").alias("direction"), F.when(n % 3 == 0, "refund|||return").otherwise("").alias("suppressors"), (100 + n).cast("string").alias("window"), F.when(n % 4 == 0, "true").otherwise("").alias("requires_ask"), (n % 6).cast("string").alias("severity")), "csv", header=True)


def _s06(t):
    read = [(r.id, r.entity, r.action, len(r.suppressors), r.window, r.requires_ask, r.severity) for r in rules.read_pack(t.spark, _pack(t))]
    return t.spark.createDataFrame(read, "id string, entity string, action string, n_suppressors int, span int, requires_ask boolean, severity int")


query("s06_rule_pack", r"""WITH b AS (SELECT DISTINCT regexp_extract(p_brand, '(\d+)', 1)::INT AS n, lower(replace(p_brand, '#', ' ')) AS b FROM part)
SELECT 'R' || n AS id, b AS entity, CASE WHEN n % 2 = 0 THEN 'buy' END AS action, CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END AS n_suppressors, 100 + n AS span, n % 4 = 0 AS requires_ask, CASE WHEN n % 6 = 0 THEN 0 ELSE n % 6 END AS severity FROM b WHERE n % 5 > 0""")(_s06)
query("s11_json_pack", "SELECT p_type AS category, list_sort(list(DISTINCT lower(p_name))) AS words FROM part GROUP BY 1")(
    lambda t: readers.json_pack(t.spark, land(t("part").groupBy(C("p_type").alias("category")).agg(F.array_sort(F.collect_set(F.lower("p_name"))).alias("words")).agg(F.to_json(F.collect_list(F.struct("category", "words"))).alias("value")), "text")).select("category", "words"))


def _s22(t):
    """Announcements of orders, a thousand a file, each file's list being JSON text within a JSON string; one says there are none."""
    key = C("o_orderkey").cast("string")
    rows = t("orders").select(F.floor(C("o_orderkey") / 1000).alias("part"), F.struct(F.concat(F.lit("Order "), key).alias("headline"), F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit('said "'), key, F.lit('"'))).alias("summary"), F.lit("C").alias("company"), F.concat(F.lit("u"), key).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")).alias("r"))
    lists = rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("v")).unionByName(t.spark.sql("select -1L as part, 'No Record Found' as v"))
    path = f"{shared_dir(t.spark)}/announced-{uuid.uuid4().hex}"
    lists.select("part", F.regexp_extract(F.to_json(F.struct("v")), r'(?s)^\{"v":(.*)\}$', 1).alias("value")).write.partitionBy("part").text(path)
    return readers.announcements(t.spark, path, 50).select("headline", "summary", "url")


query("s22_announcements", "SELECT 'Order ' || o_orderkey AS headline, CASE WHEN o_orderkey % 2 = 0 THEN 'said \"' || o_orderkey || '\"' ELSE 'Order ' || o_orderkey END AS summary, 'u' || o_orderkey AS url FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, 'u' || o_orderkey LIMIT 50")(_s22)


def _s23(t):
    """The same lists once more, written as plain JSON."""
    rows = t("orders").select(F.floor(C("o_orderkey") / 1000).alias("part"), F.struct(F.concat(F.lit("Order "), C("o_orderkey").cast("string")).alias("headline"), F.lpad(C("o_orderkey").cast("string"), 240, "x").alias("summary"), F.concat(F.lit("u"), C("o_orderkey").cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")).alias("r"))
    path = f"{shared_dir(t.spark)}/announced-{uuid.uuid4().hex}"
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("part").text(path)
    return readers.announcements(t.spark, path, 40).select("headline", "summary", "url")


query("s23_plain_announcements", "SELECT 'Order ' || o_orderkey AS headline, left(lpad(o_orderkey::VARCHAR, 240, 'x'), 200) AS summary, 'u' || o_orderkey AS url FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, 'u' || o_orderkey LIMIT 40")(_s23)
query("u01_registrable", rf"SELECT page_id, regexp_extract({HOST}, '[^.]+\.[^.]+$') AS out FROM pages")(lambda t: t("pages").select("page_id", urls.registrable(urls.host(C("url"))).alias("out")))
query("j07_exact_name", "SELECT p_partkey, p_name || ' Ltd' AS name FROM part WHERE p_partkey % 2 = 0")(
    lambda t: messages.official_contact(t("part").select("p_partkey", F.concat(F.upper(F.concat("p_name", F.lit(" "), C("p_partkey").cast("string"))), F.lit(" LIMITED")).alias("n")), "p_partkey", "n", t("part").filter("p_partkey % 2 = 0").select(F.concat("p_name", F.lit(" "), C("p_partkey").cast("string"), F.lit(" Ltd")).alias("name"), F.lit(None).cast("string").alias("domains"), F.lit(None).cast("string").alias("contact"), F.lit(None).cast("string").alias("reg_no"))).filter("by = 'exact'").select("p_partkey", F.regexp_replace("name", r" \d+ Ltd$", " Ltd").alias("name")))
query("t10_actions", """SELECT doc_id, array_to_string(list_filter([CASE WHEN bad THEN 'IMMEDIATE:DO_NOT' END, CASE WHEN v = 'UNVERIFIED' THEN 'IMMEDIATE:VERIFY' END, CASE WHEN bad AND doc_id % 3 = 0 THEN 'IMMEDIATE:REPORT_LOSS' END, CASE WHEN source IS NOT NULL AND doc_id % 5 = 0 THEN 'HIGH:OFFICIAL_CONTACT' END, CASE WHEN bad AND doc_id % 2 = 0 THEN 'HIGH:REPORT_SUPERVISOR' END, CASE WHEN bad AND doc_id % 2 = 1 THEN 'HIGH:REPORT_TAKEDOWN' END, CASE WHEN bad THEN 'MEDIUM:SHARE' END, CASE WHEN v = 'GENUINE' THEN 'INFO:SAFE_TO_READ' END], lambda x: x IS NOT NULL), ',') AS out
FROM (SELECT doc_id, source, CASE WHEN contains(text, '$$$') THEN 'FRAUDULENT' WHEN contains(text, ' | ') THEN 'UNVERIFIED' ELSE 'GENUINE' END AS v, contains(text, '$$$') AS bad FROM documents)""")(
    lambda t: t("documents").select("doc_id", F.array_join(F.transform(messages.actions(F.when(C("text").contains("$$$"), "FRAUDULENT").when(C("text").contains(" | "), "UNVERIFIED").otherwise("GENUINE"), C("doc_id") % 2 == 0, C("doc_id") % 3 == 0, F.when(C("doc_id") % 5 == 0, C("source"))), lambda a: F.concat(a["priority"], F.lit(":"), a["type"])), ",").alias("out")))
query("z04_media_summary", r"""WITH m AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: {'kind': CASE WHEN length(h) % 2 = 0 THEN 'qr' ELSE 'image' END, 'value': h}) AS items FROM pages)
SELECT page_id, len(list_filter(items, lambda x: x.kind = 'image'))::INT AS n_images, len(list_filter(items, lambda x: x.kind = 'qr'))::INT AS n_codes, array_to_string(list_transform(list_filter(items, lambda x: x.kind = 'image')[:2], lambda x: CASE WHEN length(x.value) > 6 THEN left(x.value, 3) || '...' ELSE x.value END), ' ') AS images, array_to_string(list_transform(list_filter(items, lambda x: x.kind = 'qr')[:4], lambda x: x.value), ' ') AS codes FROM m""")(
    lambda t: t("pages").select("page_id", messages.media_summary(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.struct(F.when(F.length(h) % 2 == 0, "qr").otherwise("image").alias("kind"), h.alias("value"))), 2, 4, 6).alias("m")).select("page_id", "m.n_images", "m.n_codes", F.array_join("m.images", " ").alias("images"), F.array_join("m.codes", " ").alias("codes")))
query("z30_structural_check", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'VALID_INTERMEDIARY' WHEN 1 THEN 'WALLET' ELSE 'UNKNOWN' END AS category, c_custkey % 3 = 0 AS validated, 'local_structural_rules' AS source FROM customer")(
    lambda t: messages.structural_check(t("customer").select("c_custkey", F.concat(F.lit("u"), C("c_custkey").cast("string"), F.lit("@"), F.when(C("c_custkey") % 3 == 0, "VALID").when(C("c_custkey") % 3 == 1, "pay").otherwise("none")).alias("handle")), "c_custkey", t("customer").select(F.when(C("c_custkey") % 2 == 0, "@valid").otherwise("@pay").alias("pattern"), F.when(C("c_custkey") % 2 == 0, "VALID_INTERMEDIARY").otherwise("WALLET").alias("category")).distinct()))
query("k02_gateway_rows", """SELECT sha256(text) AS content_hash, 'EMAIL' AS source_type, 'GATEWAY' AS channel, CASE WHEN contains(text, '$$$') THEN 'FRAUDULENT' ELSE 'GENUINE' END AS verdict, doc_id % 101 AS confidence, array_to_string(list_transform(range(0, least(doc_id % 20, 12)), lambda i: 'C' || i), ',') AS codes, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS matched_filing_id, doc_id % 400 AS latency_ms, left(repeat(doc_id || '-', 400), 998) AS message_id, left(coalesce(source, ''), 320) AS from_addr, '' AS to_addr, lang AS subject FROM documents""")(
    lambda t: messages.gateway_rows(t("documents").select(F.sha2("text", 256).alias("content_hash"), F.when(C("text").contains("$$$"), "FRAUDULENT").otherwise("GENUINE").alias("verdict"), (C("doc_id") % 101).alias("confidence"), F.when(C("doc_id") % 20 > 0, F.transform(F.sequence(F.lit(0).cast("long"), C("doc_id") % 20 - 1), lambda i: F.concat(F.lit("C"), i.cast("string")))).alias("codes"), F.when(C("doc_id") % 3 == 0, C("doc_id")).alias("filing"), C("source").alias("from_addr"), F.lit(None).cast("string").alias("to_addr"), C("lang").alias("subject"), F.concat(C("doc_id").cast("string"), F.lit("-")).alias("m"), (C("doc_id") % 400).alias("latency_ms")).withColumn("message_id", F.repeat("m", F.lit(400)))).withColumn("codes", F.array_join("codes", ",")))
query("z24_official_sources", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY'")(lambda t: messages.sources_of(t("part").withColumnRenamed("p_type", "category"), "ECONOMY").select("p_partkey", "p_name"))
query("z14_contact_offline", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' WHEN s_suppkey % 4 = 1 THEN 'mismatch' ELSE 'match' END AS state FROM supplier")(
    lambda t: (lambda phone: t("supplier").select("s_suppkey", registers.contact_state(F.concat(F.lit("+91 "), phone), F.when(C("s_suppkey") % 4 == 1, text.keyed_digest(F.lit("9000000000"), b"salt")).when(C("s_suppkey") % 4 > 1, text.keyed_digest(phone, b"salt")), b"salt", "phone").alias("state")))(F.concat(F.lit("98"), F.lpad(C("s_suppkey").cast("string"), 8, "1"))))
_LABEL = "list_extract(string_split({0}, '.'), -2)"
query("z15_url_features", rf"WITH h AS (SELECT page_id, regexp_replace({HOST}, '^www\.', '') AS h FROM pages) SELECT page_id, length(h)::DOUBLE AS host_len, len(string_split(h, '.'))::DOUBLE AS label_count, length(h) - length(replace(h, '-', ''))::DOUBLE AS hyphens, length(regexp_replace(h, '[^0-9]', '', 'g'))::DOUBLE AS digits, length({_LABEL.format('h')})::DOUBLE AS domain_len, contains(h, 'xn--')::DOUBLE AS has_punycode FROM h")(
    lambda t: t("pages").select("page_id", *[v.cast("double").alias(k) for k, v in (features.host_group(urls.host(C("url"))) | {"has_punycode": F.contains(urls.host(C("url")), F.lit("xn--"))}).items() if k in ("host_len", "label_count", "hyphens", "digits", "domain_len", "has_punycode")]))
