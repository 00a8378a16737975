"""Queries of tactics, channels, campaigns, histories and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import checks, entities, urls
from veriloom.operators import boards, insights, rollups, scoring
from veriloom.plans.base import query

C = F.col
HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
PARTS = "list_filter([{0}], lambda x: x IS NOT NULL)"

query("z01_tactics", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, 'password=[0-9a-f]{4}') THEN 'credential:' || regexp_extract(text, 'password=[0-9a-f]{4}') END, CASE WHEN regexp_matches(text, '\$\$\$|###') THEN 'noise:' || regexp_extract(text, '\$\$\$|###') END, CASE WHEN regexp_matches(text, '\+1 \([0-9]{3}\)') THEN 'callback:' || regexp_extract(text, '\+1 \([0-9]{3}\)') END], lambda x: x IS NOT NULL), ',') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", F.array_join(F.transform(insights.tactics(C("text"), [("credential", "password=[0-9a-f]{4}"), ("noise", r"\$\$\$|###"), ("callback", r"\+1 \([0-9]{3}\)")]), lambda x: F.concat(x.tactic, F.lit(":"), x.cue)), ",").alias("out")))
query("z07_worse_verdict", "WITH v AS (SELECT doc_id, CASE WHEN contains(text, '$$$') THEN 'suspicious' WHEN contains(text, ' | ') THEN 'unverified' ELSE 'safe' END AS a, CASE WHEN contains(text, 'token = ') THEN 'dangerous' WHEN contains(text, '+1 (') THEN 'unverified' END AS b FROM documents), r AS (SELECT *, list_position(['safe', 'unverified', 'suspicious', 'dangerous'], a) AS ra, coalesce(list_position(['safe', 'unverified', 'suspicious', 'dangerous'], b), -1) AS rb FROM v) SELECT doc_id, CASE WHEN ra >= rb THEN a ELSE b END AS out FROM r")(
    lambda t: t("documents").select("doc_id", insights.worse(F.when(C("text").contains("$$$"), "suspicious").when(C("text").contains(" | "), "unverified").otherwise("safe"), F.when(C("text").contains("token = "), "dangerous").when(C("text").contains("+1 ("), "unverified")).alias("out")))
query("z08_risk_client", "WITH s AS (SELECT doc_id, 100 - 45 * contains(text, 'token = ')::INT - 15 * contains(text, '$$$')::INT - 30 * contains(text, ' | ')::INT AS s FROM documents) SELECT doc_id, CASE WHEN s >= 80 THEN 'LOW' WHEN s >= 50 THEN 'MODERATE' WHEN s >= 25 THEN 'HIGH' ELSE 'CRITICAL' END AS out FROM s")(
    lambda t: t("documents").select("doc_id", insights.risk_client(100 - 45 * C("text").contains("token = ").cast("int") - 15 * C("text").contains("$$$").cast("int") - 30 * C("text").contains(" | ").cast("int")).alias("out")))
query("z05_not_titled", "WITH k AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(kinds, lambda x: x NOT IN ('view', 'click'))), ',') AS out FROM k")(
    lambda t: t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")).select("user_id", F.array_join(insights.not_titled(C("kinds"), F.array(F.lit("VIEW"), F.lit("Click"))), ",").alias("out")))
query("z11_lanes", "SELECT page_id, array_to_string(list_concat(list_transform(list_slice(regexp_extract_all(html, 'href=\"/([A-Za-z]+)', 1), 1, 5), lambda x: '[link] ' || x), list_transform(list_slice(regexp_extract_all(html, '<(form|script|article)', 1), 1, 3), lambda x: '[dom] ' || x)), ',') AS out FROM pages")(
    lambda t: t("pages").select("page_id", F.array_join(insights.lanes(link=(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)'), 1), 5), dom=(F.regexp_extract_all("html", F.lit("<(form|script|article)"), 1), 3), none=(F.lit(None).cast("array<string>"), 2)), ",").alias("out")))
query("z12_advice", "SELECT doc_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN contains(text, 'password=') THEN 'change it' END, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'call the bank' END, CASE WHEN contains(text, '+1 (') THEN 'do not call' END], lambda x: x IS NOT NULL), ','), ''), 'nothing to do') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", F.array_join(insights.advice([(C("text").contains("password="), "change it"), (C("text").rlike("[0-9]{16}"), "call the bank"), (C("text").contains("+1 ("), "do not call")], "nothing to do"), ",").alias("out")))
query("z38_read_confidence", "SELECT event_id, CASE WHEN event_type = 'error' OR value >= 85 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' ELSE 'UNREADABLE' END AS out FROM events")(
    lambda t: t("events").select("event_id", insights.read_confidence(C("props"), F.when(C("event_type") != "error", C("value") / 100)).alias("out")))
query("w08_match_tier", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 1 THEN 'EXACT' WHEN l_quantity < 10 THEN 'VISUAL' WHEN l_quantity <= 20 AND l_linenumber = 1 THEN 'VISUAL_WEAK' WHEN l_linenumber >= 5 THEN 'STRUCTURED' WHEN l_discount >= 0.09 OR l_tax >= 0.08 THEN 'SEMANTIC' ELSE 'NONE' END AS out FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", insights.match_tier(C("l_quantity") == 1, C("l_quantity"), F.when(C("l_linenumber") >= 5, 2).otherwise(1), C("l_linenumber") - 1, F.when(C("l_discount") >= 0.09, 0.9).otherwise(0.1), F.when(C("l_tax") >= 0.08, 0.95).otherwise(0.2)).alias("out")))
query("w02_z_score", "SELECT event_id, greatest(0.0, least(1.0, greatest(abs((value - 50) / 10), CASE WHEN event_type = 'error' THEN 0 ELSE abs((value - 20) / 30) END) / 4))::DOUBLE AS out FROM events")(
    lambda t: t("events").select("event_id", insights.z_score((C("value") - 50) / 10, F.when(C("event_type") != "error", (C("value") - 20) / 30)).alias("out")))
query("a34_app_offer", "WITH n AS (SELECT p_partkey, p_type, CASE p_partkey % 4 WHEN 0 THEN 'Zenbank_Mod_' || p_partkey || '.apk' WHEN 1 THEN 'game' || p_partkey || '.pdf.apk' WHEN 2 THEN 'tool' || p_partkey || '.apk' ELSE 'notes.txt' END AS name FROM part) SELECT p_partkey, p_partkey % 4 < 3 AS app, p_partkey % 4 = 0 AS brand, p_partkey % 4 = 1 AS disguised, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN CASE WHEN p_type = 'ECONOMY' THEN 'medium' ELSE 'low' END ELSE 'none' END AS severity, (p_partkey % 4 = 0)::INT AS claims FROM n")(
    lambda t: t("part").select("p_partkey", insights.app_offer(F.when(C("p_partkey") % 4 == 0, F.concat(F.lit("Zenbank_Mod_"), C("p_partkey").cast("string"), F.lit(".apk"))).when(C("p_partkey") % 4 == 1, F.concat(F.lit("game"), C("p_partkey").cast("string"), F.lit(".pdf.apk"))).when(C("p_partkey") % 4 == 2, F.concat(F.lit("tool"), C("p_partkey").cast("string"), F.lit(".apk"))).otherwise("notes.txt"), ("zenbank",), ("mod", "unlocked"), C("p_type") == "ECONOMY").alias("x")).select("p_partkey", "x.app", "x.brand", "x.disguised", "x.severity", F.size("x.claims").alias("claims")))
query("z48_incident", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|token') THEN 'credential' WHEN contains(lower(text), 'licens') THEN 'rights' WHEN contains(lower(text), '+1 (') THEN 'call' ELSE 'general' END AS out FROM documents")(
    lambda t: t("documents").select("doc_id", insights.incident(C("text"), [("credential", ("password", "token")), ("rights", ("licens",)), ("call", ("+1 (",))]).alias("out")))
query("z46_file_kind", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'pdf' WHEN 2 THEN 'audio' WHEN 3 THEN 'image' ELSE 'text' END AS out FROM part")(
    lambda t: t("part").select("p_partkey", insights.file_kind(F.concat(F.regexp_replace("p_name", "[. ]", "_"), F.element_at(F.array(*map(F.lit, (".MP4", ".pdf", "", ".webp", ".md"))), (C("p_partkey") % 5 + 1).cast("int"))), F.when(C("p_partkey") % 5 == 2, "audio/x-wav").otherwise("application/octet-stream")).alias("out")))
query("z37_picture_kind", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 20.0 / (l_linenumber * 100) >= 1.6 THEN 'phone_screenshot' WHEN l_discount >= 0.05 THEN 'document' WHEN l_quantity * 20.0 / (l_linenumber * 100) <= 0.7 THEN 'desktop_screenshot' ELSE 'photo' END AS out FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", insights.picture_kind(C("l_linenumber") * 100, C("l_quantity") * 20, C("l_discount") * 10).alias("out")))
query("z66_relevant_filing", "SELECT o_orderkey, o_orderpriority LIKE '1-%' OR o_orderstatus = 'F' AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", insights.relevant_filing(F.when(C("o_orderstatus") == "F", "Notice of AGM"), F.lower("o_orderpriority"), F.lit("nothing said"), ("1-urgent",)).alias("out")))
query("w05_channel_flags", r"WITH b AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), m AS (SELECT conv_id, max(n) AS most, sum(n) AS n FROM b GROUP BY 1), f AS (SELECT conv_id, bool_or(contains(text, 'http')) AS o, bool_or(regexp_matches(text, '(?i)\bforwarded\b|^> ')) AS w, bool_or(regexp_matches(text, '\?')) AS q FROM conversations GROUP BY 1) SELECT conv_id, n::BIGINT AS n, array_to_string(list_filter([CASE WHEN most >= 0.6 * n AND n >= 3 THEN 'skewed_poster_ratio' END, CASE WHEN o THEN 'off_platform_links' END, CASE WHEN w THEN 'forwarded_content' END, CASE WHEN q THEN 'funnel_words' END], lambda x: x IS NOT NULL), ',') AS flags FROM m JOIN f USING (conv_id)")(
    lambda t: insights.channel_flags(t("conversations"), "conv_id", "role", "text", r"\?").withColumn("flags", F.array_join("flags", ",")))


def sightings(t):
    e = t("events").withColumn("ts", C("ts").cast("timestamp"))
    return e.select(C("event_id").alias("obs"), "ts", F.explode(F.array(F.struct(F.lit("user").alias("type"), C("user_id").cast("string").alias("value")), F.struct(F.lit("k").alias("type"), C("props").alias("value")))).alias("s")).select("obs", "ts", "s.*")


def members(t):
    return insights.campaigns(sightings(t))


_MEMBERS = "m AS (SELECT event_id AS obs, min(event_id) OVER (PARTITION BY user_id, props) AS campaign, count(*) OVER (PARTITION BY user_id, props) AS n, ts, event_type FROM events)"
query("p04_campaigns", f"WITH {_MEMBERS} SELECT obs, campaign FROM m WHERE n > 1")(members)
query("p04_join_campaigns", f"WITH {_MEMBERS}, o AS (SELECT user_id, props, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS old, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS new FROM events GROUP BY ALL) SELECT obs, campaign FROM m WHERE n > 1")(
    lambda t: (lambda old: insights.join_campaigns(old, sightings(t), t("events").filter("ts >= timestamp'2024-01-16'").select(C("event_id").alias("obs"))))(insights.campaigns(sightings(t).filter("ts < timestamp'2024-01-16'"))))
query("t02_campaign_list", f"WITH {_MEMBERS} SELECT campaign, count(*) AS members, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen, count(DISTINCT event_type) AS channels FROM m WHERE n > 1 GROUP BY campaign ORDER BY max(ts) DESC, campaign LIMIT 50")(
    lambda t: insights.campaign_list(members(t), t("events").select(C("event_id").alias("obs"), "ts", C("event_type").alias("channel"))).withColumns({k: F.regexp_replace(F.date_format(k, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "") for k in ("first_seen", "last_seen")}))
query("t03_newest", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 500")(lambda t: rollups.newest(t("events"), 500, F.desc("ts"), C("event_id")).select("event_id", "user_id"))
query("a40_history", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, count(*) AS \"all\", count(*) FILTER (event_type = 'error') AS bad, array_to_string(list(event_id ORDER BY event_id DESC) FILTER (k <= 5), ',') AS last FROM r GROUP BY user_id")(
    lambda t: insights.history(t("events"), "user_id", "event_type = 'error'", "event_id", 5).withColumn("last", F.array_join(F.transform("last", lambda x: x.cast("string")), ",")))
query("z43_freshness", "SELECT event_type, date_diff('day', max(ts)::DATE, DATE '2024-02-01')::INT AS age_days, date_diff('day', max(ts)::DATE, DATE '2024-02-01') > 1 AS stale FROM events GROUP BY event_type")(
    lambda t: insights.freshness(t("events"), "event_type", "ts", F.to_date(F.lit("2024-02-01")), 1))
_EVAL = "WITH e AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'invalid' WHEN quality = 0 THEN 'absent' ELSE 'valid' END AS want, CASE WHEN contains(text, 'worthless') OR contains(text, 'hate') THEN 'invalid' WHEN contains(text, '$$$') OR contains(text, ' | ') THEN 'absent' ELSE 'valid' END AS got FROM documents JOIN labels USING (doc_id)), n AS (SELECT {by} count(*) AS n, count(*) FILTER (want = got) AS exact, count(*) FILTER (got IN ('invalid') AND want NOT IN ('invalid')) AS fa, count(*) FILTER (got = 'invalid' AND want = 'invalid') AS tp, count(*) FILTER (got <> 'invalid' AND want = 'invalid') AS fn FROM e {group}) SELECT {by} n, round(exact / n, 6) AS accuracy, fa AS false_accusations, round(coalesce(tp / nullif(tp + fa, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM n"


def judged(t):
    x = C("text")
    want = F.when(C("toxic") == 1, "invalid").when(C("quality") == 0, "absent").otherwise("valid")
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "source", want.alias("want"), F.when(x.contains("worthless") | x.contains("hate"), "invalid").when(x.contains("$$$") | x.contains(" | "), "absent").otherwise("valid").alias("got"))


query("z51_registration_eval", _EVAL.format(by="", group=""))(lambda t: insights.evaluated(judged(t), "want", "got", ["invalid"]))
query("z53_eval_by_source", _EVAL.format(by="source,", group="GROUP BY source"))(lambda t: insights.evaluated(judged(t), "want", "got", ["invalid"], ["source"]))
query("z57_configurations", "WITH s AS (SELECT quality AS good, 40 * contains(text, '$$$')::INT + 35 * contains(text, ' | ')::INT + 20 * contains(text, '!!')::INT AS s FROM documents JOIN labels USING (doc_id)), c(config, edge) AS (VALUES ('loose', 10), ('usual', 30), ('strict', 50)) SELECT config, count(*) FILTER (s >= edge AND good = 1) AS false_positives, count(*) FILTER (s >= edge AND good = 0) AS hits, count(*) AS n FROM s, c GROUP BY config")(
    lambda t: insights.by_configuration(t("documents").join(t("labels"), "doc_id").select((1 - C("quality")).alias("bad"), (40 * C("text").contains("$$$").cast("int") + 35 * C("text").contains(" | ").cast("int") + 20 * C("text").contains("!!").cast("int")).alias("score")), "score", "bad", {"loose": 10, "usual": 30, "strict": 50}))
query("a19_agreement", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity * p_retailprice AS filed_price, l_quantity AS qty, CASE WHEN l_linenumber > 1 THEN l_quantity + (l_linenumber = 4)::INT END AS filed_qty FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT l_orderkey, abs(price - filed_price) <= 0.005 AS a, CASE WHEN filed_qty IS NOT NULL THEN abs(qty - filed_qty) <= 0.005 END AS b FROM p) SELECT l_orderkey, count(a) + count(b) AS comparable, count(*) FILTER (a) + count(*) FILTER (b) AS matched, count(*) FILTER (NOT a) + count(*) FILTER (NOT b) AS conflicts, round(least(1.0, 0.75 + 0.08 * (count(*) FILTER (a) + count(*) FILTER (b))), 4)::DOUBLE AS score FROM o GROUP BY l_orderkey")(
    lambda t: insights.agreement(scoring.compare_fields(t("lineitem").join(t("part"), C("l_partkey") == C("p_partkey")).select("l_orderkey", C("l_extendedprice").alias("price"), (C("l_quantity") * C("p_retailprice")).alias("filed_price"), C("l_quantity").alias("qty"), F.when(C("l_linenumber") > 1, C("l_quantity") + (C("l_linenumber") == 4).cast("int")).alias("filed_qty")), "l_orderkey", {"price": 5, "qty": 4}), "l_orderkey"))
query("j28_official_match", rf"WITH h AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') OR h = 'blog.ththan.example.net' OR ends_with(h, '.blog.ththan.example.net') THEN 'exact' WHEN contains(h, 'example.org.') OR contains(h, 'example.org-') OR contains(h, 'blog.ththan.example.net.') OR contains(h, 'blog.ththan.example.net-') THEN 'stuffing' WHEN list_contains(string_split(h, '.'), 'm') OR list_contains(string_split(h, '.'), 'spam') THEN 'brand_token' ELSE 'none' END AS out FROM h")(
    lambda t: t("pages").select("page_id", insights.official_match(urls.host(C("url")), F.array(F.lit("example.org"), F.lit("blog.ththan.example.net")), ("m", "spam"), cut=r"\.").alias("out")))
query("j29_identity", rf"WITH h AS (SELECT page_id, url, {HOST} AS h FROM pages) SELECT page_id, CASE WHEN contains(url, 'utm_source') THEN 'mismatch' WHEN starts_with(h, 'm.') THEN 'imitation' WHEN contains(url, '#') THEN 'outside_namespace' WHEN ends_with(h, '.example.com') AND contains(url, '/en/') THEN 'confirmed' WHEN ends_with(h, '.example.com') THEN 'official' ELSE 'unverified' END AS out FROM h")(
    lambda t: t("pages").select("page_id", insights.identity_state(F.when(urls.host(C("url")).startswith("m."), "confusable").when(urls.host(C("url")).endswith(".example.com"), "exact").otherwise("none"), F.when(C("url").contains("#"), F.lit(False)), F.when(C("url").contains("utm_source"), "collision").when(C("url").contains("/en/"), "valid").otherwise("absent")).alias("out")))
query("z16_domain_cache", "SELECT user_id, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30 12:00:00') WHERE k = 1 GROUP BY user_id")(
    lambda t: insights.latest_within(t("events").filter("ts <= timestamp'2024-01-30 12:00:00'"), "user_id", "ts", F.to_timestamp(F.lit("2024-01-30 12:00:00")), 24).select("user_id", "event_id"))
query("p06_spaced_calls", "WITH RECURSIVE s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT DISTINCT user_id, ts FROM events)), r AS (SELECT user_id, k, ts, ts AS last, true AS ok FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, s.ts, CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN s.ts ELSE r.last END, s.ts >= r.last + INTERVAL 6 HOUR FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) SELECT event_id, ok AS allowed FROM events JOIN r USING (user_id, ts)")(
    lambda t: insights.spaced(t("events").withColumn("ts", C("ts").cast("timestamp")), "user_id", "ts", 6 * 3600).select("event_id", "allowed"))
query("a06_dashboard_counts", "SELECT count(*) AS total, count(CASE WHEN event_type <> 'error' THEN value END) AS scored, count(*) FILTER (event_type <> 'error' AND value >= 80) AS critical, count(*) FILTER (event_type <> 'error' AND value >= 60 AND value < 80) AS high FROM events")(
    lambda t: t("events").select(F.when(C("event_type") != "error", C("value") / 100).alias("s")).withColumn("band", scoring.band(C("s"))).agg(F.count(F.lit(1)).alias("total"), F.count("s").alias("scored"), F.count_if(C("band") == "Critical").alias("critical"), F.count_if(C("band") == "High").alias("high")))
query("a10_table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")(
    lambda t: rollups.table_counts({k: t(k) for k in ("documents", "pages", "events")}))
query("a42_best_ticker", "WITH b AS (SELECT o_custkey, o_orderkey, greatest(abs(o_totalprice / 1000 - 100), 0) AS z FROM orders) SELECT o_custkey, arg_max(o_orderkey, (z, -o_orderkey)) AS o_orderkey FROM b GROUP BY o_custkey")(
    lambda t: boards.greatest_of(t("orders"), "o_custkey", F.abs(C("o_totalprice") / 1000 - 100), -C("o_orderkey"), "o_orderkey").select("o_custkey", "o_orderkey"))
query("u14_private_address", r"""WITH i AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), [doc_id % 256 || '.' || doc_id * 7 % 256 || '.1.2', '172.' || doc_id % 40 || '.0.1', '192.' || (160 + doc_id % 16) || '.3.4'])) AS ip FROM documents), o AS (SELECT doc_id, ip, string_split(ip, '.')[1]::INT AS a, string_split(ip, '.')[2]::INT AS b FROM i)
SELECT doc_id, ip, a IN (0, 10, 127) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) AS out FROM o""")(
    lambda t: t("documents").select("doc_id", F.explode(F.concat(F.coalesce(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0)), F.array()), F.array(F.format_string("%d.%d.1.2", C("doc_id") % 256, C("doc_id") * 7 % 256), F.format_string("172.%d.0.1", C("doc_id") % 40), F.format_string("192.%d.3.4", 160 + C("doc_id") % 16)))).alias("ip")).select("doc_id", "ip", urls.private_ipv4(C("ip")).alias("out")))
query("u15_punycode", "SELECT c_custkey, ['bücher', '中国', 'xn--a b', 'münchen-ost', 'plain'][(c_custkey % 5 + 1)::INT] || '.example' AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", urls.unicode_host(F.concat(F.element_at(F.array(*map(F.lit, ("xn--bcher-kva", "xn--fiqs8s", "xn--a b", "xn--mnchen-ost-9db", "plain"))), (C("c_custkey") % 5 + 1).cast("int")), F.lit(".example"))).alias("out")))
query("u04_registrable_parts", rf"WITH h AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS domain, regexp_extract(h, '([^.]+)$', 1) AS suffix, regexp_extract(h, '([^.]+)\.[^.]+$', 1) AS sld, regexp_extract(h, '^(.*)\.[^.]+\.[^.]+$', 1) AS subdomains FROM h")(
    lambda t: t("pages").select("page_id", urls.registrable_parts(urls.host(C("url"))).alias("p")).select("page_id", "p.*"))

query("z20_poster_host", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'mail.nation' || c_nationkey || '.example' WHEN 1 THEN 'nation' || c_nationkey || '.example' WHEN 2 THEN 'x.example' ELSE '' END AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", insights.poster_host(F.concat(F.element_at(F.array(*map(F.lit, ("a.b@Mail.nation", "https://www.Nation", "x.example/", "Nation "))), (C("c_custkey") % 4 + 1).cast("int")), C("c_nationkey").cast("string"), F.element_at(F.array(*map(F.lit, (".example", ".example/p?q", "", ""))), (C("c_custkey") % 4 + 1).cast("int")))).alias("out")))
query("z21_tail_runs", "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'D' || length(o_custkey::VARCHAR) ELSE 'L1,D' || length(o_custkey::VARCHAR) || ',A2' END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.array_join(checks.tail_runs(F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("inz"), C("o_custkey").cast("string"))).otherwise(F.concat(F.lit("IN-"), C("o_custkey").cast("string"), F.lit("ab")))), ",").alias("out")))
query("z28_published_mark", rf"WITH h AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, CASE WHEN h LIKE 'm.%' OR h LIKE 'blog.%' THEN 'found' WHEN page_id % 2 = 0 THEN 'none' ELSE 'not_checked' END AS record, h LIKE 'm.%' AS has_vmc FROM h")(
    lambda t: insights.published_mark(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", t("pages").select(urls.host(C("url")).alias("domain")).distinct().filter("domain like 'm.%' or domain like 'blog.%'").withColumn("certificate", F.when(C("domain").startswith("m."), "c")), C("page_id") % 2 == 0).select("page_id", "record", "has_vmc"))
query("z36_forward_marks", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'licens') OR contains(lower(text), 'rights') THEN 'rights' END, CASE WHEN contains(text, '!!') THEN 'shout' END], lambda x: x IS NOT NULL), ',') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", F.array_join(insights.forward_marks(C("text"), {"rights": ("licens", "rights"), "shout": ("!!",)}), ",").alias("out")))
query("z40_candidate_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ',' ELSE '' END || '2020-01-05,2021-02-06' AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.array_join(F.transform(insights.candidate_dates(F.array(F.when(C("o_orderkey") % 3 == 0, F.to_date("o_orderdate"))), entities.dates(F.lit("on 2020-01-05 and 2021-02-06, again 2020-01-05"))), lambda d: d.cast("string")), ",").alias("out")))
query("z42_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 16) AS out FROM documents")(lambda t: t("documents").select("doc_id", insights.fingerprint(C("text")).alias("out")))
query("z44_explanation", "WITH k AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_type <> 'error')) AS kinds FROM events GROUP BY 1) SELECT user_id, coalesce(array_to_string(list_transform(kinds, lambda x: 'saw ' || x), '; '), 'nothing to say') AS out FROM k")(
    lambda t: t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")).select("user_id", insights.explanation(F.transform("kinds", lambda k: F.struct((k != "error").alias("available"), F.concat(F.lit("saw "), k).alias("summary"))), "nothing to say").alias("out")))
query("z45_preview_media", r"SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN url WHEN page_id % 2 = 0 THEN url ELSE '' END AS out FROM pages")(
    lambda t: t("pages").select("page_id", F.array_join(insights.preview_media(F.array(F.struct(F.when(C("url").startswith("https://"), "image").when(C("page_id") % 2 == 0, "video").otherwise("text").alias("kind"), C("url").alias("url")), F.struct(F.lit("image").alias("kind"), F.lit("data:x").alias("url")), F.struct(F.when(C("page_id") % 2 == 0, "video").otherwise("other").alias("kind"), C("url").alias("url")))), ",").alias("out")))
query("t12_playbook", "WITH k AS (SELECT event_id, event_type FROM events), s(kind, priority, step) AS (VALUES ('error', 1, 'stop'), ('error', 4, 'report'), ('*', 3, 'keep notes'), ('purchase', 2, 'call the bank'), ('*', 4, 'report'), ('purchase', 5, 'wait')), b AS (SELECT event_id, step, min(priority) AS p FROM k JOIN s ON kind IN (event_type, '*') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p, step) AS n FROM b) SELECT event_id, string_agg(step, ',' ORDER BY n) AS steps FROM r WHERE n <= 3 GROUP BY event_id")(
    lambda t: insights.playbook(t("events"), "event_id", "event_type", t.spark.createDataFrame([("error", 1, "stop"), ("error", 4, "report"), ("*", 3, "keep notes"), ("purchase", 2, "call the bank"), ("*", 4, "report"), ("purchase", 5, "wait")], "kind string, priority int, step string"), 3).withColumn("steps", F.array_join("steps", ",")))
query("a38_drift", "WITH d AS (SELECT l_linenumber, abs(l_quantity - l_discount * 100) AS d FROM lineitem) SELECT l_linenumber, round(avg(d), 4) AS mean, quantile_cont(d, 0.5) AS median, min(d) AS least, max(d) AS most, count(*) AS n FROM d GROUP BY 1")(
    lambda t: insights.drift(t("lineitem").select("l_linenumber", F.abs(C("l_quantity") - C("l_discount") * 100).alias("d")), "l_linenumber", "d"))
query("j16_domain_ages", rf"WITH h AS (SELECT page_id, {HOST} AS h FROM pages), w AS (SELECT h, min(page_id) AS k FROM h GROUP BY h HAVING min(page_id) % 3 > 0) SELECT page_id, (k * 10)::INT AS days, coalesce(k * 10 < 90, false) AS young FROM h LEFT JOIN w USING (h)")(
    lambda t: insights.domain_ages(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", t("pages").groupBy(urls.host(C("url")).alias("domain")).agg(F.min("page_id").alias("k")).filter("k % 3 > 0").select("domain", F.date_sub(F.to_date(F.lit("2024-06-01")), (C("k") * 10).cast("int")).alias("created")), F.to_date(F.lit("2024-06-01"))).select("page_id", "days", "young"))
query("t08_top_clusters", "SELECT props, count(DISTINCT user_id) AS users FROM events GROUP BY props ORDER BY users DESC, props LIMIT 5")(
    lambda t: insights.top_clusters(t("events").groupBy("props").agg(F.count_distinct("user_id").alias("users")), "users", "props"))
query("z69_contract_status", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) = count(*) FILTER (o_orderstatus = 'F') AS all_good FROM orders")(
    lambda t: insights.all_hold(t("orders"), "o_orderstatus", "F"))
query("x11_is_handle", r"""WITH w AS (SELECT conv_id, turn, text || ' pay ab' || conv_id || CASE turn % 3 WHEN 0 THEN '@okbank' WHEN 1 THEN '@mail.example.com' ELSE ' @x' END AS t FROM conversations) SELECT conv_id, turn, regexp_matches(regexp_replace(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g'), '\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,}\b') AS out FROM w""")(
    lambda t: t("conversations").select("conv_id", "turn", (F.size(entities.handles(F.concat(C("text"), F.lit(" pay ab"), C("conv_id").cast("string"), F.when(C("turn") % 3 == 0, "@okbank").when(C("turn") % 3 == 1, "@mail.example.com").otherwise(" @x")))) > 0).alias("out")))
query("x17_registration_shapes", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'INZ' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'ARN-' || (10000 + o_custkey) ELSE 'IN-DP-12-3456' END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.array_join(entities.registration_shapes(F.concat(F.lit("regd. "), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("INZ"), F.lpad(C("o_custkey").cast("string"), 9, "0"))).when(C("o_orderkey") % 3 == 1, F.concat(F.lit("arn-"), (10000 + C("o_custkey")).cast("string"))).otherwise("in-dp-12-3456"), F.lit(" with us"))), ",").alias("out")))
query("x20_references", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SEBI/HO/' || o_custkey || ',' ELSE '' END || '12/2024' AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.array_join(entities.references(F.concat(F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("see circular no. sebi/ho/"), C("o_custkey").cast("string"), F.lit(" and "))).otherwise(""), F.lit("PR No. 12/2024 of today"))), ",").alias("out")))
