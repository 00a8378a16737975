"""Queries of rules, markup, sources, models and streams, and of smaller helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import entities, markup, urls
from veriloom.operators import boards, gates, lookups, models, rules, scoring
from veriloom.plans.base import query
from veriloom.sources import readers
from veriloom.streaming import flows

C = F.col
HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
#: What the SQL states of a hit: its case folding gives a to z from two letters beside ASCII, and nothing near a hit speaks for or against it.
PACK = [rules.Rule("token", r"""token = ["']?[0-9a-f]{8}""", r"[0-9a-f]{8}", None, (), 60, False, 5), rules.Rule("license", "l(?a:[i\u0130])cen(?a:s)e", None, None, (), 120, False, 4), rules.Rule("shout", "!! (?a:[A-Z\u0130\u212a])+!!", ".", None, (), 40, False, 3), rules.Rule("broken", "((", None)]

query("r01_rules", r"""WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents)
SELECT doc_id, 'token' AS rule, 5 AS severity FROM d WHERE regexp_matches(t, 'token = ') AND regexp_matches(text, '(?i)token = ["'']?[0-9a-f]{8}') UNION ALL SELECT doc_id, 'license', 1 FROM d WHERE contains(t, 'license')""")(
    lambda t: rules.evaluate(t("documents"), PACK[:2]).select("doc_id", "rule", "severity"))
_HITS = r"""WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents), h AS (SELECT 'token' AS rule, 5 AS severity FROM d WHERE regexp_matches(t, 'token = ') AND regexp_matches(text, '(?i)token = ["'']?[0-9a-f]{8}') UNION ALL SELECT 'license', 1 FROM d WHERE contains(t, 'license') UNION ALL SELECT 'shout', 3 FROM d WHERE regexp_matches(t, '!! [a-z]+!!'))"""
query("r02_compile", f"{_HITS} SELECT rule, count(*) AS n, max(severity)::INT AS severity FROM h GROUP BY rule")(lambda t: rules.evaluate(t("documents"), PACK).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity")))
query("x09_mask")(lambda t: rules.mask(t("documents")).select("doc_id", F.sha2("masked", 256).alias("masked"), F.size("spans").alias("n")))
query("x23_page_links", r"SELECT page_id, len(regexp_extract_all(html, '<a[\s>]'))::INT AS n_links, len(regexp_extract_all(html, '<form[\s>]'))::INT AS n_forms, len(regexp_extract_all(html, '<script[\s>]'))::INT AS n_scripts FROM pages")(
    lambda t: t("pages").select("page_id", markup.page(C("html")).alias("p")).select("page_id", "p.n_links", "p.n_forms", "p.n_scripts"))
query("x24_dom_depth")(lambda t: t("pages").select("page_id", markup.page(C("html")).alias("p")).select("page_id", "p.depth", F.length("p.text").alias("chars")))
query("s18_plain_text", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS out FROM pages")(
    lambda t: t("pages").select("page_id", F.sha2(markup.plain_text(C("html")), 256).alias("out")))
query("s14_kind_of", r"""SELECT 'd' || doc_id AS id, CASE WHEN regexp_matches(left(text, 500), '(?im)^(from|received|return-path|message-id):') THEN 'EMAIL' WHEN regexp_matches(trim(left(text, 512)), '^https?://\S+$') THEN 'URL' ELSE 'TEXT' END AS out FROM documents UNION ALL SELECT 'u' || page_id, CASE WHEN page_id % 5 = 0 THEN 'PDF' ELSE 'URL' END FROM pages UNION ALL SELECT 'm' || page_id, 'EMAIL' FROM pages""")(
    lambda t: t("documents").select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("id"), F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("name"))
    .unionByName(t("pages").select(F.concat(F.lit("u"), C("page_id").cast("string")).alias("id"), F.encode("url", "UTF-8").alias("data"), F.when(C("page_id") % 5 == 0, "Paper.PDF").alias("name")))
    .unionByName(t("pages").select(F.concat(F.lit("m"), C("page_id").cast("string")).alias("id"), F.encode(F.concat(F.lit("Subject: x\nFrom: a@"), urls.host(C("url")), F.lit("\n\n"), C("html")), "UTF-8").alias("data"), F.lit(None).cast("string").alias("name")))
    .select("id", markup.kind_of(C("data"), C("name")).alias("out")))
query("s16_message", "SELECT c_custkey, 'Re: ' || c_name AS subject, lower('u' || c_custkey || '@mail.example') AS from_address, 'hello ' || c_mktsegment AS text FROM customer")(
    lambda t: t("customer").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions"))).select("c_custkey", markup.message(F.encode(F.concat(F.lit("From: Someone <U"), C("c_custkey").cast("string"), F.lit("@mail.example>\nSubject: Re: "), "c_name", F.lit("\nContent-Type: text/plain\n\nhello "), "c_mktsegment"), "UTF-8")).alias("m")).select("c_custkey", "m.subject", "m.from_address", "m.text"))
query("s17_authentication", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END AS spf, 'pass' AS dkim, 'seg' || c_nationkey || '.example' AS signer FROM customer")(
    lambda t: t("customer").select("c_custkey", markup.authentication(F.concat(F.lit("mx.example; spf="), F.when(C("c_custkey") % 2 == 0, "pass").otherwise("fail"), F.lit(" smtp.mailfrom=x; dkim=pass header.d=Seg"), C("c_nationkey").cast("string"), F.lit(".example"))).alias("a")).select("c_custkey", "a.spf", "a.dkim", "a.signer"))
query("s29_date_windows", "WITH r AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders) SELECT strftime(d, '%Y-%m-%d') AS first, strftime(least(d + INTERVAL 29 DAY, b), '%Y-%m-%d') AS last FROM (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 30 DAY)) AS d, b FROM r)")(
    lambda t: (lambda r: readers.date_windows(t.spark, str(r[0]), str(r[1])).select(C("first").cast("string").alias("first"), C("last").cast("string").alias("last")))(t("orders").agg(F.min(C("o_orderdate").cast("date")), F.max(C("o_orderdate").cast("date"))).first()))
query("s30_select_companies", "WITH g AS (SELECT p_partkey, p_size AS scrip, ['A','B','T','Q'][(p_partkey % 4 + 1)::INT] AS grp FROM part), r AS (SELECT scrip, min(CASE grp WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'T' THEN 3 END) AS r FROM g WHERE grp <> 'Q' GROUP BY scrip) SELECT scrip, ['A','B','T'][r] AS grp FROM r ORDER BY r, scrip LIMIT 20")(
    lambda t: readers.select_companies(t("part").select(C("p_size").alias("scrip"), C("p_name").alias("isin"), F.element_at(F.array(*map(F.lit, "ABTQ")), (C("p_partkey") % 4 + 1).cast("int")).alias("grp")), 20).select("scrip", "grp"))
query("s10_blocklist_host", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE 'bad' || s_suppkey || '.example' END AS out FROM supplier")(
    lambda t: t("supplier").select("s_suppkey", readers.blocklist_host(F.concat(F.element_at(F.array(*map(F.lit, ("0.0.0.0 ", "||", "www.", "# "))), (C("s_suppkey") % 4 + 1).cast("int")), F.lit("Bad"), C("s_suppkey").cast("string"), F.lit(".example"))).alias("out")))
query("s31_chat_header", "SELECT o_orderkey, 'Clerk ' || o_custkey AS sender, strftime(o_orderdate, '%Y-%m-%d') || ' 21:05:00' AS sent_at FROM orders")(
    lambda t: t("orders").select("o_orderkey", markup.chat_header(F.concat(F.lit("[9:05 pm, "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("] Clerk "), C("o_custkey").cast("string"), F.lit(": hello"))).alias("h")).select("o_orderkey", "h.sender", "h.sent_at"))
query("s32_chat_entities", "SELECT conv_id, turn, len(regexp_extract_all(text, 'https?://[^\\s\\)\\]\\}<>\"'']+'))::INT AS n_urls, role = 'user' AS outgoing FROM conversations")(
    lambda t: t("conversations").select("conv_id", "turn", F.size(entities.chat_entities(C("text"))["urls"]).alias("n_urls"), (C("role") == "user").alias("outgoing")))
query("z63_prefix_shapes", "SELECT 'CUSTOMER' AS prefix, count(*) AS n, min(length(regexp_replace(c_name, '[^0-9]', '', 'g')))::INT AS least, max(length(regexp_replace(c_name, '[^0-9]', '', 'g')))::INT AS most FROM customer")(lambda t: readers.prefix_shapes(t("customer"), "c_name"))
query("z64_validity", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') END AS b FROM orders")(
    lambda t: t("orders").select("o_orderkey", readers.validity(F.concat(F.date_format("o_orderdate", "dd-MMM-yyyy"), F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit(" to "), F.date_format(F.date_add("o_orderdate", 365), "dd-MMM-yyyy"))).otherwise(" - Perpetual"))).alias("v")).select("o_orderkey", C("v.start").cast("string").alias("a"), C("v.end").cast("string").alias("b")))
query("z61_fabricated", "SELECT DISTINCT n FROM (SELECT unnest([o_custkey * 3, o_custkey + o_orderkey]) AS n FROM orders) WHERE n NOT IN (SELECT c_custkey FROM customer)")(
    lambda t: lookups.unlisted(t("orders").select(F.explode(F.array(C("o_custkey") * 3, C("o_custkey") + C("o_orderkey"))).alias("n")), "n", t("customer"), "c_custkey"))
query("z62_source_selection", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")(
    lambda t: boards.newest_of(t("orders"), "o_orderstatus = 'P'", "o_orderdate", "o_orderkey", 6).select("o_orderkey"))
query("z02_conversation_counts", "SELECT conv_id, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers, count(*) AS turns FROM conversations GROUP BY conv_id")(
    lambda t: boards.conversation_counts(t("conversations"), "conv_id", "text"))
query("z03_qr_value", r"""WITH v AS (SELECT page_id, unnest(list_concat([url, 'upi://pay?pa=' || page_id || '@bank'], regexp_extract_all(html, '>([^<>]{3,40})<', 1))) AS v FROM pages)
SELECT page_id, CASE WHEN starts_with(v, 'upi:') THEN 'payment' WHEN regexp_matches(v, '^https?:') THEN 'link' ELSE 'text' END AS kind, count(*) AS n FROM v GROUP BY ALL""")(
    lambda t: t("pages").select("page_id", F.explode(F.concat(F.array(C("url"), F.concat(F.lit("upi://pay?pa="), C("page_id").cast("string"), F.lit("@bank"))), F.regexp_extract_all("html", F.lit(">([^<>]{3,40})<"), F.lit(1)))).alias("v")).groupBy("page_id", urls.qr_kind(C("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
query("z10_sensitive_fields", "SELECT p_partkey, (p_partkey % 3 < 2)::INT AS n FROM part")(
    lambda t: t("part").select("p_partkey", boards.sensitive_fields(F.array(F.lit("city"), F.element_at(F.array(*map(F.lit, ("otp", "card_pin", "name"))), (C("p_partkey") % 3 + 1).cast("int")))).alias("n")))
query("z17_selector_health", "SELECT user_id, CASE WHEN avg((event_type = 'click')::INT) >= 0.8 THEN 'HEALTHY' WHEN avg((event_type = 'click')::INT) >= 0.4 THEN 'DEGRADED' ELSE 'BLIND' END AS out FROM events GROUP BY user_id")(
    lambda t: t("events").groupBy("user_id").agg(F.avg((C("event_type") == "click").cast("int")).alias("r")).select("user_id", scoring.band(C("r"), ((0.8, "HEALTHY"), (0.4, "DEGRADED")), "BLIND").alias("out")))
query("z19_channel_flags", "SELECT conv_id, count(*) >= 4 AND count(DISTINCT role) <= 2 AS few_posters, bool_or(contains(text, 'http')) AS links FROM conversations GROUP BY conv_id")(
    lambda t: boards.channel_trust(t("conversations"), "conv_id", "role", "text"))
query("z34_filing_type", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'DIVIDEND' WHEN o_orderstatus = 'F' THEN 'AGM' ELSE 'OTHER' END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", entities.document_type(F.concat_ws(" ", F.when(C("o_orderpriority") == "1-URGENT", "Final dividend"), F.when(C("o_orderstatus") == "F", "Annual General Meeting"))).alias("out")))
query("z39_comparators", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 1 THEN abs(l_extendedprice - round(l_extendedprice, 0)) <= 0.005 END AS out FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", boards.same_amount(C("l_extendedprice"), F.when(C("l_linenumber") > 1, F.round("l_extendedprice", 0))).alias("out")))
query("z47_tolerant_json", """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""")(
    lambda t: t("events").select("event_id", boards.tolerant(C("props"), "$.k", "long").alias("k")))
query("z54_cube", "SELECT event_type, user_id % 3 AS tier, round(avg(value), 6) AS mean FROM events GROUP BY CUBE (event_type, user_id % 3)")(
    lambda t: boards.cube_means(t("events").select(C("event_type").alias("kind"), "user_id", "value"), "value", 6, event_type=C("kind"), tier=C("user_id") % 3))
query("z59_parity", "WITH a AS (SELECT l_partkey AS k, avg(l_extendedprice / l_quantity) AS price, count(*)::DOUBLE AS n FROM lineitem WHERE l_discount > 0 GROUP BY 1), b AS (SELECT p_partkey AS k, p_retailprice AS price, 1.0::DOUBLE AS n FROM part), j AS (SELECT a.price AS ap, b.price AS bp, a.n AS an, b.n AS bn FROM a FULL JOIN b USING (k)) SELECT 'price' AS measure, count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL) AS compared, count(*) FILTER (ap IS NULL) AS lost_left, count(*) FILTER (bp IS NULL) AS lost_right, round(max(abs(ap - bp)), 6) AS most, coalesce(max(abs(ap - bp)), 0) <= 0.02 AS within FROM j UNION ALL SELECT 'n', count(*) FILTER (an IS NOT NULL AND bn IS NOT NULL), count(*) FILTER (an IS NULL), count(*) FILTER (bn IS NULL), round(max(abs(an - bn)), 6), coalesce(max(abs(an - bn)), 0) <= 0.02 FROM j")(
    lambda t: models.parity(t("lineitem").filter("l_discount > 0").groupBy(C("l_partkey").alias("k")).agg(F.avg(C("l_extendedprice") / C("l_quantity")).alias("price"), F.count(F.lit(1)).cast("double").alias("n")), t("part").select(C("p_partkey").alias("k"), C("p_retailprice").alias("price"), F.lit(1.0).alias("n")), "k", ["price", "n"]).withColumn("most", F.round("most", 6)))
query("z68_checks_header", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type || '=' || CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END)), ';') AS out FROM events GROUP BY user_id")(
    lambda t: boards.checks_header(t("events"), "user_id", "event_type", C("event_type") != "error").withColumnRenamed("header", "out"))
query("z70_severity_tier", "SELECT l_partkey, max(l_linenumber)::INT AS s, CASE WHEN max(l_linenumber) >= 5 THEN 'critical' WHEN max(l_linenumber) >= 3 THEN 'warning' ELSE 'info' END AS tier FROM lineitem GROUP BY l_partkey")(
    lambda t: t("lineitem").groupBy("l_partkey").agg(F.max("l_linenumber").cast("int").alias("s")).withColumn("tier", scoring.band(C("s"), ((5, "critical"), (3, "warning")), "info")))
HOST = rf"regexp_replace({HOST}, '^www\.', '')"
_F = {"host_len": f"length({HOST})", "label_count": f"len(string_split({HOST}, '.'))", "hyphens": f"length({HOST}) - length(replace({HOST}, '-', ''))", "digits": f"length(regexp_replace({HOST}, '[^0-9]', '', 'g'))", "tld_len": f"length(list_extract(string_split({HOST}, '.'), -1))", "longest_label": f"list_max(list_transform(string_split({HOST}, '.'), lambda x: length(x)))"}
query("m08_host_features", "SELECT page_id, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _F.items()) + " FROM pages")(lambda t: models.with_features(t("pages")).select("page_id", *_F))
query("m14_linear_score", f"SELECT page_id, round(1 / (1 + exp(-(0.1::DOUBLE + 0.05::DOUBLE * length({HOST}) - 0.4::DOUBLE * len(string_split({HOST}, '.'))))), 6) AS p FROM pages")(
    lambda t: models.with_features(t("pages")).select("page_id", F.round(models.linear_score({"host_len": 0.05, "label_count": -0.4}, 0.1)["p"], 6).alias("p")))
query("m15_route", f"WITH s AS (SELECT page_id, url, 1 / (1 + exp(-(0.1::DOUBLE + 0.05::DOUBLE * length({HOST}) - 0.4::DOUBLE * len(string_split({HOST}, '.'))))) AS p FROM pages) SELECT page_id, CASE WHEN p >= 0.5 OR contains(url, '.example.org') THEN 'warn' WHEN p < 0.4 AND NOT contains(url, '.example.net') THEN 'allow' ELSE 'escalate' END AS out FROM s")(
    lambda t: models.with_features(t("pages")).select("page_id", models.route(models.linear_score({"host_len": 0.05, "label_count": -0.4}, 0.1)["p"], F.when(C("url").contains(".example.org"), "invalid").when(C("url").contains(".example.net"), "unverified").otherwise("valid"), 0.4, 0.5).alias("out")))
query("m16_measures", "WITH s AS (SELECT doc_id, quality AS y, (doc_id % 10) / 10.0::DOUBLE AS p FROM labels), t AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM t), e AS (SELECT sum(y) AS pp, avg((p - y) * (p - y)) AS brier FROM s) SELECT round(sum(pos / pp * tp / k), 6) AS average_precision, round(max(brier), 6) AS brier FROM c, e")(
    lambda t: models.measures(t("labels").select(C("quality").alias("y"), (C("doc_id") % 10 / 10.0).alias("p"))).select(F.round("average_precision", 6).alias("average_precision"), F.round("brier", 6).alias("brier")))


def _trained(t):
    names = ["n_chars", "symbols", "bars", "repeats"]
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", "source", (1 - C("quality")).alias("y"), C("n_chars").cast("double").alias("n_chars"), F.regexp_count("text", F.lit("[#$%&*]")).cast("double").alias("symbols"), F.regexp_count("text", F.lit(" \\| ")).cast("double").alias("bars"), F.regexp_count("text", F.lit("!!")).cast("double").alias("repeats"))
    train, test = models.split(d, C("source"))
    return models.score(test, models.fit(train, names), names).select("doc_id", "y", (C("p") >= 0.5).cast("int").alias("got"))


query("m11_logistic")(_trained)
query("m12_bootstrap")(lambda t: models.bootstrap_mcc(t("labels").select(C("quality").alias("y"), C("toxic").alias("got")), "got", "y"))
query("m13_folds", "SELECT source, count(*) AS n, 1::BIGINT AS n_folds, true AS in_range FROM documents GROUP BY source")(
    lambda t: models.folds(t("documents"), C("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("n_folds"), F.min(C("fold").between(0, 4)).alias("in_range")))
query("p01_gateway", r"""SELECT doc_id::VARCHAR AS message_id, CASE WHEN f THEN 'FRAUDULENT' ELSE 'GENUINE' END AS verdict, CASE WHEN f THEN '[FRAUD] ' ELSE '' END || coalesce(lang, '') AS subject FROM (SELECT doc_id, lang, contains(lower(text), 'password=') OR regexp_matches(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g'), '\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,}\b') AS f FROM documents)""")(
    lambda t: flows.delivered(flows.file_stream(t.spark, f"{t.folder}/documents.parquet").select(C("doc_id").cast("string").alias("message_id"), C("source").alias("sender"), C("lang").alias("subject"), C("text").alias("body")), lambda m: m.select("message_id", F.when(gates.has_ask(C("body"), ("password=",)), "FRAUDULENT").otherwise("GENUINE").alias("verdict"))).select("message_id", "verdict", "subject"))
query("p03_stream_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")(
    lambda t: flows.run_to_table(flows.first_seen(flows.with_time(flows.file_stream(t.spark, f"{t.folder}/events.parquet"), "ts", "3650 days"), "user_id", "event_type").select("user_id", "event_type")))
query("p_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda t: flows.run_to_table(flows.tumbling(flows.with_time(flows.file_stream(t.spark, f"{t.folder}/events.parquet"), "ts", "1 hour"), "ts", "1 hour", "event_type"), "complete").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"))
query("p_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, s")(
    lambda t: flows.run_to_table(flows.sessions(flows.with_time(flows.file_stream(t.spark, f"{t.folder}/events.parquet"), "ts", "1 hour"), "ts", "2 hours", "user_id"), "complete").select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n"))
query("p02_rate_limited_stream", "WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, event_id, k, true AS accepted, NULL::TIMESTAMP AS a, ts AS b FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, a IS NULL OR a <= e.ts - INTERVAL 1 HOUR, CASE WHEN a IS NULL OR a <= e.ts - INTERVAL 1 HOUR THEN b ELSE a END, CASE WHEN a IS NULL OR a <= e.ts - INTERVAL 1 HOUR THEN e.ts ELSE b END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, user_id, accepted FROM r")(lambda t: flows.run_to_table(flows.rate_limited(flows.file_stream(t.spark, f"{t.folder}/events.parquet").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 3600)).select("event_id", "user_id", "accepted"))
query("k10_stamp", "SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN 'FRAUDULENT' ELSE 'GENUINE' END AS v, array_to_string(list_sort(list_filter([CASE WHEN lang IS NOT NULL THEN 'Subject=' || lang END, 'X-Other=' || doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'From=' || source END], lambda x: x IS NOT NULL)), ';') AS kept FROM documents")(
    lambda t: t("documents").select("doc_id", flows.stamp(F.map_filter(F.create_map(F.lit("x-VERILOOM-verdict"), F.lit("forged"), F.lit("Subject"), C("lang"), F.lit("X-Other"), C("doc_id").cast("string"), F.when(C("doc_id") % 2 == 0, "X-Veriloom-Old").otherwise("From"), C("source")), lambda k, v: v.isNotNull()), F.when(C("text").contains("token = "), "FRAUDULENT").otherwise("GENUINE")).alias("h")).select("doc_id", C("h")["X-Veriloom-Verdict"].alias("v"), F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("h", lambda k, v: k != "X-Veriloom-Verdict")), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("kept")))
query("x27_attachment", "SELECT c_custkey, 'file' || c_custkey || '.apk' AS name, '12 MB' AS size FROM customer")(
    lambda t: t("customer").select("c_custkey", entities.attachment(F.concat(F.lit("see file"), C("c_custkey").cast("string"), F.lit(".apk (12 MB)"))).alias("a")).select("c_custkey", "a.name", "a.size"))
query("f20_amended", r"SELECT doc_id, regexp_matches(lower(text), '\b(?:amended|amendment|corrigendum|revised|version)\b') AS out FROM documents")(lambda t: t("documents").select("doc_id", gates.amended(C("text"), (*gates.AMENDED, "version")).alias("out")))
query("f22_authority_demand", r"SELECT doc_id, regexp_matches(text, '(?i)licens|rights reserved') AND (contains(text, 'token =') OR contains(text, 'password=') OR contains(text, '$$$') OR contains(text, '***')) AND NOT regexp_matches(lower(text), '\bnever\b') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", gates.authority_demand(C("text"), "(?i)licens|rights reserved", ("token =", "password=", "$$$", "***"), r"\bnever\b").alias("out")))
query("a36_rule_counts", f"{_HITS} SELECT rule, count(*) AS n FROM h GROUP BY rule")(lambda t: rules.evaluate(t("documents"), PACK).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
query("a33_cap_trust", "SELECT doc_id, least(100 - 10 * len(regexp_extract_all(text, '[0-9]{4}')), CASE WHEN contains(text, 'token =') THEN 20 ELSE 100 END, CASE WHEN contains(text, 'Licens') THEN 45 ELSE 100 END)::INT AS out FROM documents")(
    lambda t: t("documents").select("doc_id", scoring.capped(100 - 10 * F.regexp_count("text", F.lit("[0-9]{4}")), [(C("text").contains("token ="), 20), (C("text").contains("Licens"), 45)]).cast("int").alias("out")))
query("a32_offline_gate", "SELECT doc_id, greatest(0, least(100, 85 - CASE WHEN contains(text, '$$$') THEN 18 ELSE 0 END - CASE WHEN contains(text, '!!') THEN 12 ELSE 0 END - CASE WHEN contains(text, 'token =') THEN 24 ELSE 0 END))::INT AS out FROM documents")(
    lambda t: t("documents").select("doc_id", scoring.clamp(F.lit(85) - gates.weighted(C("text"), {"$$$": 18, "!!": 12, "token =": 24}), 0, 100).alias("out")))
