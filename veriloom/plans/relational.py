"""Queries of gates, scores, joins, rollups, ordered analytics and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom.functions import urls
from veriloom.operators import boards, gates, lookups, rollups, scoring, series, similar
from veriloom.plans.base import query

C = F.col
HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
#: Packs of the queries: words that occur in the tables.
ASKS, WORDS = ("token =", "license", "@mail"), ("with", "from", "this", "that", "avec", "und")
WEIGHTS = {"token": 30, "license": 20, "###": 15, "$$$": 15, "!!": 10, "555-": 25, "@mail": 25}
TACTICS = {"urgency": (18, ("!!", "now")), "secrecy": (22, ("token", "secret")), "authority": (20, ("license", "terms")), "money": (25, ("$$$", "%%%"))}
COMBOS = {"pressure": (("urgency", "authority"), 14), "theft": (("secrecy", "money"), 20)}


def hits(words, c: str = "lower(text)") -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def flag(name: str, expr, sql: str, columns: str = "text"):
    query(name, f"SELECT doc_id, {sql} AS out FROM documents")(lambda t: t("documents").select("doc_id", expr(C(columns)).alias("out")))


flag("f01_has_ask", lambda c: gates.has_ask(c, ("token =", "license")), r"(contains(regexp_replace(lower(text), '\b(?:never|do not|don''t)\s+(?:share|send|pay|click|download)[^.\n]*', ' ', 'g'), 'token =') OR contains(lower(text), 'license') OR regexp_matches(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g'), '\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,}\b'))")
flag("f03_message_is_asking", lambda c: gates.asking(c, ASKS), f"({hits(ASKS)} > 0) OR contains(text, '?')")
flag("f04_awareness", lambda c: gates.awareness(c, ("license", "terms", "version")), f"{hits(('license', 'terms', 'version'))} >= 2 AND NOT regexp_matches(text, '\\b[A-Z]{{4}}0[A-Z0-9]{{6}}\\b') AND NOT regexp_matches(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '', 'g'), '\\b[a-zA-Z0-9._-]{{2,}}@[a-zA-Z]{{2,}}\\b')")
flag("f05_negated", lambda c: gates.negated(c, "the ", 42, r"\b(?:of|and|not)\b"), r"strpos(lower(text), 'the ') > 0 AND regexp_matches(substr(lower(text), greatest(strpos(lower(text), 'the ') - 42, 1), least(strpos(lower(text), 'the ') - 1, 42)), '\b(?:of|and|not)\b')")
flag("f06_near", lambda c: gates.near(c, "license", "version|terms"), "strpos(text, 'license') > 0 AND regexp_matches(substr(text, greatest(strpos(text, 'license') - 140, 1), 287), 'version|terms')")
flag("f07_context", lambda c: gates.context(c, WORDS), f"{hits(WORDS)} > 0")
query("f08_gate", "SELECT doc_id, ((contains(text, '!!') OR contains(text, '$$$')) OR contains(text, 'token =')) AS out FROM documents")(
    lambda t: t("documents").select("doc_id", gates.gated(gates.firsts(("!!", C("text").contains("!!")), ("$$$", C("text").contains("$$$")), ("license", C("text").contains("license"))), ("license",), C("text").contains("token =")).alias("out")))
query("f09_cap_alone", f"SELECT doc_id, (CASE WHEN (contains(lower(text), '!!')::INT + contains(lower(text), '$$$')::INT) <= 1 AND NOT contains(text, 'token =') THEN least(s, 20) ELSE s END)::INT AS out FROM (SELECT *, {' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{k}{chr(39)}) THEN {w} ELSE 0 END' for k, w in WEIGHTS.items())} AS s FROM documents)")(
    lambda t: t("documents").select("doc_id", gates.cap_alone(gates.weighted(F.lower("text"), WEIGHTS), gates.firsts(("a", F.lower("text").contains("!!")), ("b", F.lower("text").contains("$$$"))), C("text").contains("token ="), 20).alias("out")))
flag("f10_lexicon", lambda c: gates.lexicon(c, WORDS), f"{hits(WORDS)} >= 2")
query("f11_scope", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {hits(WORDS)} >= 2 THEN 'T0' END, CASE WHEN lang = 'de' THEN 'T3' END], lambda x: x IS NOT NULL), ',') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", F.array_join(F.filter(gates.scope(C("text"), C("lang") == "de", WORDS), lambda x: x.isin("T0", "T3")), ",").alias("out")))
flag("f12_input_gate", gates.input_gate, r"CASE WHEN regexp_matches(lower(text), 'ignore (?:all |the )?previous instructions|system prompt|disregard the above') THEN 'BLOCK' WHEN regexp_matches(lower(text), '\bi am (?:the )?(?:admin|regulator|support)\b') THEN 'WARN' ELSE 'ALLOW' END")
query("f13_output_gate", "SELECT doc_id, CASE WHEN r >= 60 THEN 'BLOCK' WHEN r >= 30 THEN 'REVIEW' ELSE 'ALLOW' END AS out FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 40 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'http') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{9,}') THEN 20 ELSE 0 END AS r FROM documents)")(
    lambda t: t("documents").select("doc_id", gates.output_gate(C("text"), F.when(C("doc_id") % 3 == 0, "payment").when(C("doc_id") % 3 == 1, "link").otherwise("display")).alias("out")))
query("f14_url_gate", r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^(javascript|data|vbscript):') OR regexp_matches(url, '(?i)\.(exe|apk|scr|bat|msi)(\?|#|$)') THEN 'BLOCK' WHEN starts_with(url, 'http://') OR length(url) > 200 THEN 'WARN' ELSE 'ALLOW' END AS out FROM pages")(lambda t: t("pages").select("page_id", gates.url_gate(C("url")).alias("out")))
query("f15_download_gate", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'WARN' ELSE 'ALLOW' END AS out FROM part")(
    lambda t: t("part").select("p_partkey", gates.download_gate(F.concat(F.lit("a"), F.element_at(F.array(*map(F.lit, (".apk", ".pdf.zip", ".pdf", ".png"))), (C("p_partkey") % 4 + 1).cast("int"))), F.when(C("p_partkey") % 4 == 3, "image/png").otherwise("text/html")).alias("out")))
query("f16_form_gate", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 40 WHEN p_partkey % 3 = 1 THEN 30 ELSE 10 END::INT AS out FROM part")(
    lambda t: t("part").select("p_partkey", gates.form_gate(F.array(F.lit("user_email"), F.element_at(F.array(*map(F.lit, ("otp_code", "card_no", "city"))), (C("p_partkey") % 3 + 1).cast("int"))), C("p_size") % 5 == 0).alias("out")))
flag("f17_clipboard_gate", lambda c: F.array_join(gates.clipboard_gate(c), ","), r"array_to_string(list_filter([CASE WHEN regexp_matches(text, '\b[0-9]{13,19}\b') THEN 'card' END, CASE WHEN regexp_matches(text, '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b') THEN 'ip' END, CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}') THEN 'email' END], lambda x: x IS NOT NULL), ',')")
query("f18_recipient_allowed", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) OR c_mktsegment LIKE 'B%'")(
    lambda t: gates.allowed(t("customer").withColumn("a", F.concat(F.lit("u"), C("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"))), "a", t("supplier").join(t("customer"), C("s_suppkey") == C("c_custkey")).select(F.concat(F.lit("U"), C("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment")).alias("value")), t("customer").filter("c_mktsegment like 'B%'").select(C("c_mktsegment").alias("value")).distinct()).select("c_custkey"))
query("f19_postdates_corpus", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(l_shipdate) - INTERVAL 1500 DAY FROM lineitem)")(
    lambda t: boards.postdates(t("orders"), "o_orderdate", t("lineitem"), "l_shipdate", 1500).select("o_orderkey"))
query("f21_within_coverage", "SELECT o_orderkey, year(o_orderdate) BETWEEN 1996 AND 1999 AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", boards.within_years(C("o_orderdate"), 1996, 1999).alias("out")))
query("f23_list_content", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(
    lambda t: boards.listing(t("orders"), "o_orderpriority", "high", "o_totalprice", 1000, "o_orderkey", 50).select("o_orderkey", "o_totalprice"))
query("f24_blocked_claims", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(text, 'icense'))
SELECT doc_id, (i - 1)::INT AS line FROM l WHERE len(list_filter(range(1, length(s) + 1), lambda k: substr(s, k, 6) = 'icense' AND NOT regexp_matches(substr(s, greatest(k - 40, 1), least(k - 1, 40)), '\b(?:not|no|never|work)\b'))) > 0""")(
    lambda t: gates.blocked_claims(t("documents"), "icense", 40, r"\b(?:not|no|never|work)\b"))

_SIGNALS = """WITH s AS (SELECT doc_id AS content_id, 'text' AS name, (doc_id * 7 % 100) / 100.0::DOUBLE AS score, true AS available FROM documents
UNION ALL SELECT doc_id, 'source', (doc_id * 13 % 100) / 100.0::DOUBLE, doc_id % 3 <> 0 FROM documents UNION ALL SELECT doc_id, 'market', (doc_id * 31 % 100) / 100.0::DOUBLE, doc_id % 4 = 1 FROM documents
UNION ALL SELECT doc_id, 'registry', 1.0::DOUBLE, doc_id % 10 = 0 FROM documents), w AS (SELECT *, CASE name WHEN 'text' THEN 0.25 WHEN 'source' THEN 0.15 WHEN 'market' THEN 0.10 ELSE 0 END::DOUBLE AS w FROM s)"""


def _signals(t):
    d, part = t("documents"), lambda name, k, ok: F.struct(F.lit(name).alias("name"), ((C("doc_id") * k % 100) / 100.0).cast("double").alias("score"), ok.alias("available"))
    return d.select(C("doc_id").alias("content_id"), F.explode(F.array(part("text", 7, F.lit(True)), part("source", 13, C("doc_id") % 3 != 0), part("market", 31, C("doc_id") % 4 == 1), F.struct(F.lit("registry").alias("name"), F.lit(1.0).alias("score"), (C("doc_id") % 10 == 0).alias("available")))).alias("s")).select("content_id", "s.*")


query("a11_fusion", _SIGNALS + """, g AS (SELECT content_id, coalesce(sum(w * score) FILTER (available AND w > 0) / sum(w) FILTER (available AND w > 0), 0) AS mean, bool_or(name = 'registry' AND available) AS signed, count(*) FILTER (available AND w > 0) AS n_live FROM w GROUP BY content_id),
f AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN signed THEN least(mean, 0.29) ELSE mean END)), 4)::DOUBLE AS score FROM g)
SELECT content_id, score, CASE WHEN score >= 0.8 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' ELSE 'Low' END AS band, n_live FROM f""")(lambda t: scoring.fuse(_signals(t)).drop("driver"))
query("a12_band_rollup", _SIGNALS + ", g AS (SELECT content_id, round(greatest(0.0, least(1.0, CASE WHEN bool_or(name = 'registry' AND available) THEN least(coalesce(sum(w * score) FILTER (available AND w > 0) / sum(w) FILTER (available AND w > 0), 0), 0.29) ELSE coalesce(sum(w * score) FILTER (available AND w > 0) / sum(w) FILTER (available AND w > 0), 0) END)), 4) AS score FROM w GROUP BY content_id) SELECT CASE WHEN score >= 0.8 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS n FROM g GROUP BY ALL")(
    lambda t: scoring.fuse(_signals(t)).groupBy("band").agg(F.count(F.lit(1)).alias("n")))
query("r15_driver", _SIGNALS + " SELECT content_id, arg_min(name, (-w * score, list_position(['text', 'voice', 'video', 'source', 'coordination', 'market'], name))) AS driver FROM w WHERE available AND w > 0 GROUP BY content_id")(lambda t: scoring.fuse(_signals(t)).select("content_id", "driver"))


def _checks(t):
    one = lambda name, k: F.struct(F.lit(name).alias("check"), F.when(C("doc_id") % k == 0, F.lit(None).cast("boolean")).otherwise(C("doc_id") % k == 1).alias("passed"), ((C("doc_id") * k % 10) / 10.0).cast("double").alias("confidence"))
    return t("documents").select(C("doc_id").alias("msg_id"), F.explode(F.array(one("MONEY", 3), one("ENTITY", 4), one("CLAIM", 5))).alias("c")).select("msg_id", "c.*")


_CHECKS = " UNION ALL ".join(f"SELECT doc_id AS msg_id, {w}::DOUBLE AS w, CASE WHEN doc_id % {k} = 0 THEN NULL ELSE doc_id % {k} = 1 END AS passed, (doc_id * {k} % 10) / 10.0::DOUBLE AS confidence FROM documents" for w, k in ((1.5, 3), (1.2, 4), (1.0, 5)))
query("a13_confidence", f"SELECT msg_id, floor(100 * sum(CASE WHEN passed IS NULL THEN 0.0::DOUBLE ELSE w * greatest(confidence, 0.35::DOUBLE) END) / sum(w) + 0.5)::INT AS evidence FROM ({_CHECKS}) GROUP BY msg_id")(lambda t: scoring.confidence(_checks(t)))


def _verdicts(t):
    d = t("documents")
    found = gates.firsts(("symbols", C("text").contains("$$$")), ("token", C("text").contains("token =")), ("shout", C("text").contains("!!")), ("phone", C("text").contains("555-")), ("mail", C("text").contains("@mail")))
    grave = F.col("code") == "token"
    reasons = d.select(C("doc_id").alias("msg_id"), F.explode(found).alias("code")).select("msg_id", F.lit("CLAIM").alias("check"), "code", F.when(grave, 5).when(C("code").isin("phone", "mail"), 4).otherwise(3).alias("severity"), grave.alias("disqualifying"))
    messages = d.select(C("doc_id").alias("msg_id"), (C("doc_id") % 2 == 0).alias("asks"), (C("doc_id") % 37 == 0).alias("tampered"), (C("doc_id") % 4).cast("int").alias("passes"))
    return scoring.ladder(reasons, messages)


query("a15_verdict_ladder", """WITH m AS (SELECT doc_id AS msg_id, doc_id % 2 = 0 AS asks, doc_id % 37 = 0 AS tampered, (doc_id % 4)::INT AS passes, contains(text, 'token =') AS grave, contains(text, '$$$')::INT + contains(text, '!!')::INT AS n3, contains(text, '555-')::INT + contains(text, '@mail')::INT AS n4 FROM documents),
v AS (SELECT *, CASE WHEN tampered THEN 'TAMPERED' WHEN grave THEN 'FRAUDULENT' WHEN NOT asks THEN CASE WHEN passes >= 2 THEN 'GENUINE' ELSE 'UNVERIFIED' END WHEN n3 + n4 >= 2 THEN 'FRAUDULENT' WHEN passes > n3 + n4 THEN 'GENUINE' ELSE 'UNVERIFIED' END AS raw FROM m),
c AS (SELECT *, (CASE raw WHEN 'FRAUDULENT' THEN least(100, 55 + 15 * grave::INT + 5 * least(n4, 2) + 15 * grave::INT) WHEN 'TAMPERED' THEN 90 ELSE 40 + 10 * least(passes, 5) END)::INT AS confidence FROM v)
SELECT msg_id, CASE WHEN confidence < CASE raw WHEN 'FRAUDULENT' THEN 70 WHEN 'TAMPERED' THEN 65 WHEN 'GENUINE' THEN 60 ELSE 0 END THEN 'UNVERIFIED' ELSE raw END AS verdict, confidence, (n3 + n4 + grave::INT)::INT AS n_reasons FROM c""")(_verdicts)
_T = {k: f"({' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)})" for k, (_, words) in TACTICS.items()}
_B = "least(100, " + " + ".join([f"CASE WHEN {_T[k]} THEN {w} ELSE 0 END" for k, (w, _) in TACTICS.items()] + [f"CASE WHEN {' AND '.join(_T[k] for k in need)} THEN {b} ELSE 0 END" for need, b in COMBOS.values()]) + ")"
query("a22_behaviour", f"SELECT doc_id, s::INT AS score, CASE WHEN s >= 80 THEN 'severe' WHEN s >= 60 THEN 'strong' WHEN s >= 40 THEN 'moderate' WHEN s >= 20 THEN 'weak' ELSE 'none' END AS band, least(CASE WHEN s >= 80 THEN 65 WHEN s >= 60 THEN 50 WHEN s >= 40 THEN 35 WHEN s >= 20 THEN 15 ELSE 10 END, round_even(s * 0.65, 0))::INT AS penalty FROM (SELECT doc_id, {_B} AS s FROM documents)")(
    lambda t: t("documents").select("doc_id", scoring.behaviour(C("text"), TACTICS, COMBOS).alias("b")).select("doc_id", "b.*"))
query("r19_behaviour_client", f"SELECT doc_id, s::INT AS score, CASE WHEN s >= 80 THEN 'severe' WHEN s >= 60 THEN 'strong' WHEN s >= 40 THEN 'moderate' WHEN s >= 20 THEN 'weak' ELSE 'none' END AS band, least(CASE WHEN s >= 80 THEN 65 WHEN s >= 60 THEN 50 WHEN s >= 40 THEN 35 WHEN s >= 20 THEN 15 ELSE 10 END, round(s * 0.65::DOUBLE, 0))::INT AS penalty FROM (SELECT doc_id, {_B} AS s FROM documents)")(
    lambda t: t("documents").select("doc_id", scoring.behaviour(C("text"), TACTICS, COMBOS, True).alias("b")).select("doc_id", "b.*"))
_K = "least(100, " + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {w} ELSE 0 END" for k, w in WEIGHTS.items()) + ")"
query("a23_keyword_score", f"SELECT doc_id, s::INT AS score, CASE WHEN s >= 75 THEN 'DANGER' WHEN s >= 45 THEN 'WARN' WHEN s >= 25 THEN 'CAUTION' ELSE 'SAFE' END AS level FROM (SELECT doc_id, {_K} AS s FROM documents)")(
    lambda t: t("documents").select("doc_id", scoring.keyword_score(C("text"), WEIGHTS).alias("k")).select("doc_id", "k.*"))
query("a25_second_scorer", f"SELECT doc_id, CASE WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 45 THEN 'HIGH' WHEN s >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT doc_id, {_K} AS s FROM documents)")(
    lambda t: t("documents").select("doc_id", scoring.keyword_score(C("text"), WEIGHTS, ((70, "CRITICAL"), (45, "HIGH"), (20, "MEDIUM")))["level"].alias("l")).select("doc_id", F.when(C("l") == "SAFE", "LOW").otherwise(C("l")).alias("level")))
query("a26_credibility", r"""SELECT doc_id, greatest(0, least(100, 60 + CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN -15 ELSE 0 END - 8 * (regexp_matches(text, '!{2,}')::INT + regexp_matches(text, '[A-Z]{4,} [A-Z]{4,}')::INT + (len(regexp_extract_all(text, '!')) > 5)::INT)
+ trunc(15.0 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) / len(string_split(text, chr(10))))))::INT AS out FROM documents""")(
    lambda t: t("documents").select("doc_id", scoring.credibility(C("text"), F.when(C("lang") == "en", 20).when(C("lang") == "de", -15).otherwise(0)).alias("out")))
query("a29_trust_total", "SELECT doc_id, greatest(0, least(100, trunc(70::DOUBLE + coalesce(30 - 0.9::DOUBLE * CASE WHEN doc_id % 3 > 0 THEN doc_id % 100 END, 0) + 0.3::DOUBLE * (doc_id % 90 - 60) + coalesce(0.4::DOUBLE * (CASE WHEN doc_id % 5 > 0 THEN doc_id % 77 END - 60), 0) - 0.3::DOUBLE * (doc_id % 11) - 5 * (doc_id % 2))))::INT AS out FROM documents")(
    lambda t: t("documents").select("doc_id", scoring.trust_total(F.when(C("doc_id") % 3 > 0, C("doc_id") % 100), C("doc_id") % 90, F.when(C("doc_id") % 5 > 0, C("doc_id") % 77), C("doc_id") % 11, (C("doc_id") % 2)).alias("out")))
query("a31_worst_state", "WITH s AS (SELECT user_id, (event_id % 7)::INT AS r FROM events), g AS (SELECT user_id, min(r) AS r FROM s GROUP BY user_id) SELECT user_id, ['collision','invalid','absent','weak_match','unverified','not_applicable','valid'][r + 1] AS state, ([-45, -40, -20, -10, 0, 0, 25][r + 1])::INT AS delta FROM g")(
    lambda t: scoring.worst_state(t("events").select("user_id", F.element_at(F.array(*map(F.lit, scoring.STATES)), (C("event_id") % 7 + 1).cast("int")).alias("s")), "user_id", "s"))
query("z09_risk_level", "WITH s AS (SELECT doc_id, 100 - 40 * contains(text, 'token = ')::INT - 30 * contains(text, '$$$')::INT - 20 * contains(text, ' | ')::INT AS trust FROM documents) SELECT doc_id, CASE WHEN trust >= 75 THEN 'LOW' WHEN trust >= 50 THEN 'MODERATE' WHEN trust >= 25 THEN 'HIGH' ELSE 'CRITICAL' END AS out FROM s")(
    lambda t: t("documents").select("doc_id", scoring.risk_level(100 - gates.weighted(C("text"), {"token = ": 40, "$$$": 30, " | ": 20})).alias("out")))
query("r10_preflight", "SELECT page_id, CASE WHEN contains(url, 'spam-farm') THEN 'L5' WHEN contains(url, '.example.net') THEN 'L4' WHEN contains(url, 'utm_source') THEN 'L3' WHEN starts_with(url, 'http://') THEN 'L2' WHEN contains(url, '#') THEN 'L1' ELSE 'L0' END AS out FROM pages")(
    lambda t: t("pages").select("page_id", scoring.preflight(gates.firsts(("L1", C("url").contains("#")), ("L3", C("url").contains("utm_source")), ("L5", C("url").contains("spam-farm")), ("L2", C("url").startswith("http://")), ("L4", C("url").contains(".example.net")))).alias("out")))
query("a20_compare_fields", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity * p_retailprice AS filed_price, l_quantity AS qty, CASE WHEN l_linenumber > 1 THEN l_quantity END AS filed_qty FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_partkey, 'price' AS field, count(*) AS n, count(*) FILTER (abs(price - filed_price) <= 0.005) AS agree FROM p GROUP BY ALL UNION ALL SELECT l_partkey, 'qty', count(*), count(*) FROM p WHERE filed_qty IS NOT NULL GROUP BY ALL""")(
    lambda t: scoring.compare_fields(t("lineitem").join(t("part"), C("l_partkey") == C("p_partkey")).select("l_partkey", C("l_extendedprice").alias("price"), (C("l_quantity") * C("p_retailprice")).alias("filed_price"), C("l_quantity").alias("qty"), F.when(C("l_linenumber") > 1, C("l_quantity")).alias("filed_qty")), "l_partkey", {"price": 5, "qty": 4}).groupBy("l_partkey", "field").agg(F.count(F.lit(1)).alias("n"), F.count_if("agrees").alias("agree")))

query("j01_shared_entities", """WITH s AS (SELECT DISTINCT user_id AS obs, date_trunc('day', ts) AS ts, event_type AS type, props AS value FROM events)
SELECT a.obs AS a, b.obs AS b, count(*) AS shared FROM s a JOIN s b ON a.type = b.type AND a.value = b.value AND a.obs < b.obs AND abs(datediff('day', a.ts, b.ts)) <= 1 GROUP BY ALL HAVING count(*) >= 2""")(
    lambda t: lookups.shared_entities(t("events").select(C("user_id").alias("obs"), F.date_trunc("day", C("ts")).cast("timestamp").alias("ts"), C("event_type").alias("type"), C("props").alias("value")), 1, 2))
query("j02_handles_of_key", "SELECT a.value, b.value AS with_value, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS obs, l_partkey AS value FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS obs, l_suppkey AS value FROM lineitem) b USING (obs) GROUP BY ALL")(
    lambda t: lookups.seen_with(t("lineitem").select(C("l_orderkey").alias("obs"), F.lit("reg").alias("type"), C("l_partkey").alias("value")).unionByName(t("lineitem").select(C("l_orderkey").alias("obs"), F.lit("handle").alias("type"), C("l_suppkey").alias("value"))), "reg", "handle"))
query("j03_detail", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders")(
    lambda t: boards.in_order(t("orders"), "o_custkey", C("o_orderdate"), C("o_orderkey")).select("o_custkey", "o_orderkey", "place"))
query("j04_or_join", "SELECT DISTINCT s_suppkey, c_custkey FROM supplier, customer WHERE s_acctbal = c_acctbal OR s_suppkey = c_custkey")(
    lambda t: lookups.or_join(t("supplier").withColumn("k", C("s_suppkey").cast("string")).withColumn("b", C("s_acctbal").cast("string")), t("customer").withColumn("ck", C("c_custkey").cast("string")).withColumn("cb", C("c_acctbal").cast("string")), {"k": "ck", "b": "cb"}, "s_suppkey", "c_custkey"))
query("j05_date_window", """WITH c AS (SELECT o_orderkey, l_linenumber, l_partkey, abs(datediff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 45 AS near FROM orders JOIN lineitem ON o_orderkey = l_orderkey), a AS (SELECT *, bool_or(near) OVER (PARTITION BY o_orderkey) AS any_ FROM c)
SELECT o_orderkey, l_linenumber, l_partkey FROM a WHERE near OR NOT any_""")(
    lambda t: lookups.date_window(t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey")), "o_orderkey", "o_orderdate", "l_shipdate").select("o_orderkey", "l_linenumber", "l_partkey"))
query("j06_later", "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'F' AND a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 60 DAY)")(
    lambda t: lookups.later(t("orders").withColumn("marked", C("o_orderstatus") == "F"), "o_custkey", "o_orderdate", "marked").select("o_orderkey"))
query("j10_longest_name", """WITH w AS (SELECT DISTINCT p_name FROM part), f AS (SELECT o_orderkey, ' ' || p_name || ' with ' || o_orderpriority AS s FROM orders JOIN part ON o_orderkey % 100 = p_partkey), g AS (SELECT o_orderkey, p_name FROM f, w WHERE contains(s, ' ' || p_name || ' '))
SELECT o_orderkey, arg_max(p_name, (length(p_name), p_name)) AS name FROM g GROUP BY o_orderkey""")(
    lambda t: lookups.longest_name(lookups.names_in_text(t("orders").join(t("part"), C("o_orderkey") % 100 == C("p_partkey")).select("o_orderkey", F.concat(F.lit(" "), "p_name", F.lit(" with "), "o_orderpriority").alias("s")), "o_orderkey", "s", t("part").select(C("p_name").alias("name"), F.lower("p_name").alias("normalised")).distinct()), "o_orderkey"))
query("j11_names_in_text", "WITH n AS (SELECT name FROM (SELECT lower(regexp_extract(text, '^[A-Za-z]+')) AS name, count(*) AS k FROM documents GROUP BY 1) WHERE k >= 10 AND name <> ''), d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9#]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id, name FROM d, n WHERE contains(t, ' ' || name || ' ')")(
    lambda t: lookups.names_in_text(t("documents"), "doc_id", "text", t("documents").groupBy(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 10 and name <> ''").select("name", C("name").alias("normalised")), 1, 1))
query("j08_resolve", "SELECT s_suppkey, s_name AS registered FROM supplier")(
    lambda t: lookups.resolve(t("supplier").select("s_suppkey", F.concat(F.lower(F.regexp_replace("s_name", "#0*", " ")), F.when(C("s_suppkey") % 2 == 0, " india").otherwise("")).alias("n")), "s_suppkey", "n", t("supplier").select(C("s_name").alias("registered"), F.lower(F.regexp_replace("s_name", "#0*", " ")).alias("normalised"))).select("s_suppkey", "registered"))
query("j14_priority", "SELECT user_id, arg_min(event_type, (event_id)) AS event_type FROM events GROUP BY user_id")(lambda t: lookups.priority(t("events"), "user_id", "event_id", "event_type"))
query("j15_prefix_join", "SELECT c_custkey, any_value(s_name) AS bank FROM customer LEFT JOIN supplier ON s_suppkey < 60 AND upper(substr(md5(c_mktsegment), 1, 1)) || c_nationkey % 60 = upper(substr(md5('BUILDING'), 1, 1)) || s_suppkey GROUP BY c_custkey")(
    lambda t: lookups.by_prefix(t("customer").select("c_custkey", F.concat(F.upper(F.substring(F.md5("c_mktsegment"), 1, 1)), F.lpad((C("c_nationkey") % 60).cast("string"), 3, "0"), F.lit("0"), "c_name").alias("code")), "code", t("supplier").filter("s_suppkey < 60").select(F.concat(F.upper(F.substring(F.md5(F.lit("BUILDING")), 1, 1)), F.lpad(C("s_suppkey").cast("string"), 3, "0")).alias("prefix"), C("s_name").alias("bank")), "prefix", 4).select("c_custkey", "bank"))
query("j17_lookalikes", "WITH k AS (SELECT n_name AS name, n_nationkey AS ord FROM nation), h AS (SELECT s_suppkey, 'NATION_' || (s_suppkey % 97) AS l FROM supplier), c AS (SELECT s_suppkey, name, levenshtein(l, name) AS d, ord FROM h, k WHERE levenshtein(l, name) BETWEEN 1 AND 2) SELECT s_suppkey, arg_min(d, (d, ord))::INT AS edits FROM c GROUP BY s_suppkey")(
    lambda t: lookups.lookalikes(t("supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (C("s_suppkey") % 97).cast("string")).alias("l")), "s_suppkey", "l", t("nation").select(C("n_name").alias("name"), C("n_nationkey").alias("ord")), skeletons=False).filter("edits > 0").select("s_suppkey", "edits"))
query("j20_blocklist", f"WITH l(host) AS (VALUES ('example.com'), ('thther.example.org'), ('example.net')), h AS (SELECT page_id, {HOST} AS h FROM pages) SELECT page_id, arg_max(host, length(host)) AS matched FROM h JOIN l ON h = host OR ends_with(h, '.' || host) GROUP BY page_id")(
    lambda t: lookups.by_suffix(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", t.spark.createDataFrame([("example.com",), ("thther.example.org",), ("example.net",)], "host string")).select("page_id", "matched"))
query("j21_registration_state", "SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'invalid' ELSE 'unverified' END WHEN c_nationkey = s_nationkey THEN 'valid' ELSE 'collision' END AS state FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")(
    lambda t: boards.registration_state(t("customer"), "c_custkey", "c_nationkey", t("supplier"), "s_suppkey", "s_nationkey", C("c_custkey") % 2 == 0).select("c_custkey", "state"))
query("j27_set_operations", "WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS a FROM documents) SELECT doc_id, len(list_filter(a, lambda x: list_contains(['the', 'de', 'der'], x)))::INT AS both, len(list_filter(['the', 'de', 'der'], lambda x: NOT list_contains(a, x)))::INT AS missing FROM w")(
    lambda t: t("documents").select("doc_id", boards.divergence(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "de", "der")))).alias("d")).select("doc_id", "d.both", "d.missing"))
query("j30_templates", "WITH h AS (SELECT conv_id, turn, sha256(left(text, 6)) AS h FROM conversations) SELECT conv_id, count(*) AS rows FROM h WHERE h IN (SELECT h FROM h GROUP BY 1 HAVING count(DISTINCT conv_id) > 1) GROUP BY 1")(
    lambda t: rollups.shared_templates(t("conversations").select("conv_id", F.sha2(F.left("text", F.lit(6)), 256).alias("h")), "conv_id", "h").groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")))
query("j31_dedup_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")(lambda t: rollups.latest(t("events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "value"))
query("j32_feed_agreement", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, html FROM pages), f AS (SELECT DISTINCT host, 'a' AS feed FROM h WHERE contains(html, '$$$') UNION SELECT DISTINCT host, 'b' FROM h WHERE contains(html, '<form') UNION SELECT DISTINCT host, 'c' FROM h WHERE starts_with(host, 'spam'))
SELECT page_id, count(feed)::INT AS feeds, coalesce(string_agg(feed, ',' ORDER BY feed), '') AS named, round(CASE WHEN count(feed) > 0 THEN 0.5 + 0.5 * count(feed) / 3 ELSE 0 END, 4)::DOUBLE AS confidence FROM h LEFT JOIN f USING (host) GROUP BY page_id""")(
    lambda t: lookups.feed_agreement(t("pages").select("page_id", urls.host(C("url")).alias("host")), "page_id", "host", (lambda h: h.filter(C("html").contains("$$$")).select("host", F.lit("a").alias("feed")).unionByName(h.filter(C("html").contains("<form")).select("host", F.lit("b").alias("feed"))).unionByName(h.filter(C("host").startswith("spam")).select("host", F.lit("c").alias("feed"))))(t("pages").select(urls.host(C("url")).alias("host"), "html")), 3).withColumn("named", F.array_join("named", ",")))

query("a01_by_verdict", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY event_type")(
    lambda t: boards.counts_since(t("events"), "event_type", "ts", F.expr("timestamp_ntz '2024-01-02'")))
query("a02_top_spoofed", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")(
    lambda t: boards.most_frequent(t("events").filter("event_type = 'error'"), "user_id", 10))
query("a03_clusters", "SELECT props, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, max(event_type) AS verdict, arg_min(user_id, (ts, user_id)) AS user_id FROM events GROUP BY props HAVING count(*) >= 2")(
    lambda t: rollups.clusters(t("events"), "props", "ts", "event_type", "user_id").select("props", "n", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "verdict", "user_id"))
query("a04_mean_latency", "SELECT event_type, round(avg(value), 1) AS mean FROM events GROUP BY event_type")(
    lambda t: boards.means(t("events"), "event_type", "value"))
query("a05_corpus_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark")(
    lambda t: rollups.table_counts({n: t(n) for n in ("documents", "pages", "benchmark")}))
query("a07_ticker_counts", "SELECT t, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY t ORDER BY n DESC, t LIMIT 20")(
    lambda t: boards.most_frequent(t("part").select(F.explode(F.split("p_name", " ")).alias("t")), "t", 20))
query("a08_regulator_rollup", "WITH x AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT event_type, user_id % 5 AS grp, count(*) AS n FROM x WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM x) GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")(
    lambda t: boards.rollup_of_newest(t("events").select("ts", "event_id", C("event_type").alias("kind"), "user_id"), "ts", "event_id", 1000, 7, event_type=C("kind"), grp=C("user_id") % 5))
query("a09_corpus_status", "SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS as_of, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS stale FROM events GROUP BY event_type")(
    lambda t: boards.corpus_status(t("events"), "event_type", "ts", 3))
query("a21_bursts", "WITH g AS (SELECT props, count(DISTINCT user_id) AS handles, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY props HAVING count(DISTINCT user_id) >= 3) SELECT props, handles, round(0.5 * least(1.0, (handles - 2) / 12.0) + 0.5 * CASE WHEN us / 6e7 <= 60 THEN 1.0 ELSE greatest(0.0, 1 - (us / 6e7 - 60) / 1440) END, 4) AS score FROM g")(
    lambda t: similar.bursts(t("events").withColumn("ts", C("ts").cast("timestamp")), "props", "user_id", "ts").select("props", "handles", "score"))
query("a35_confusion", "WITH r AS (SELECT quality AS e, CASE WHEN contains(text, '$$$') OR contains(text, ' | ') THEN 0 ELSE 1 END AS g FROM labels JOIN documents USING (doc_id)), c(class) AS (VALUES (0), (1)) SELECT class, count(*) FILTER (e = class AND g = class) AS tp, count(*) FILTER (e <> class AND g = class) AS fp, count(*) FILTER (e = class AND g <> class) AS fn FROM r, c GROUP BY class")(
    lambda t: rollups.confusion(t("labels").join(t("documents"), "doc_id").select(C("quality").alias("e"), F.when(C("text").contains("$$$") | C("text").contains(" | "), 0).otherwise(1).alias("g")), "e", "g", [0, 1]))
query("z58_prf", "WITH r AS (SELECT quality AS e, CASE WHEN contains(text, '$$$') OR contains(text, ' | ') THEN 0 ELSE 1 END AS g FROM labels JOIN documents USING (doc_id)), k AS (SELECT count(*) FILTER (e = 0 AND g = 0) AS tp, count(*) FILTER (e = 1 AND g = 0) AS fp, count(*) FILTER (e = 0 AND g = 1) AS fn FROM r) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k")(
    lambda t: rollups.confusion(t("labels").join(t("documents"), "doc_id").select(C("quality").alias("e"), F.when(C("text").contains("$$$") | C("text").contains(" | "), 0).otherwise(1).alias("g")), "e", "g", [0, 1]).filter("class = 0").select(scoring.prf(C("tp"), C("fp"), C("fn")).alias("p")).select(F.round("p.precision", 6).alias("precision"), F.round("p.recall", 6).alias("recall"), F.round("p.f1", 6).alias("f1")))
query("a37_feature_mcc", "WITH r AS (SELECT quality = 0 AS y, contains(text, '$$$') AS x FROM labels JOIN documents USING (doc_id)), k AS (SELECT count(*) FILTER (x AND y)::DOUBLE AS tp, count(*) FILTER (x AND NOT y)::DOUBLE AS fp, count(*) FILTER (NOT x AND y)::DOUBLE AS fn, count(*) FILTER (NOT x AND NOT y)::DOUBLE AS tn FROM r) SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM k")(
    lambda t: t("labels").join(t("documents"), "doc_id").select((C("quality") == 0).alias("y"), C("text").contains("$$$").alias("x")).agg(F.count_if(C("x") & C("y")).alias("tp"), F.count_if(C("x") & ~C("y")).alias("fp"), F.count_if(~C("x") & C("y")).alias("fn"), F.count_if(~C("x") & ~C("y")).alias("tn")).select(F.round(scoring.mcc(C("tp"), C("fp"), C("fn"), C("tn")), 6).alias("mcc")))
query("a39_field_vote", "WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), k AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS all_votes, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS k FROM v) SELECT user_id, event_type AS value, votes, all_votes::BIGINT AS all_votes, 2 * votes > all_votes AS agreed FROM k WHERE k = 1")(lambda t: rollups.vote(t("events"), "user_id", "event_type"))
query("a41_worst_segment", "SELECT user_id, max(value) AS value, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY user_id")(
    lambda t: boards.greatest_of(t("events"), "user_id", C("value"), C("event_id"), "event_id"))

_BARS = "SELECT l_partkey AS ticker, l_shipdate::DATE AS day, round(sum(l_extendedprice) / sum(l_quantity), 4) AS close, sum(l_quantity)::BIGINT AS volume FROM lineitem GROUP BY ALL"
query("w01_market", f"""WITH b AS ({_BARS}), r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS ret FROM b), e AS (SELECT ticker, max(day) AS ed FROM b GROUP BY ticker),
j AS (SELECT r.*, ed, day >= ed - 2 AS inside FROM r JOIN e USING (ticker) WHERE day <= ed + 2), p AS (SELECT *, row_number() OVER (PARTITION BY ticker, inside ORDER BY day DESC) AS place FROM j),
g AS (SELECT ticker, ed, count(*) FILTER (NOT inside) AS n_base, avg(volume) FILTER (NOT inside) AS vm, stddev_samp(volume) FILTER (NOT inside) AS vs, stddev_samp(ret) FILTER (NOT inside) AS rs, max(volume) FILTER (inside) AS peak, max(abs(ret)) FILTER (inside) AS mv FROM p WHERE inside OR place <= 20 GROUP BY ALL)
SELECT ticker, n_base, round(CASE WHEN vs > 0 THEN (peak - vm) / vs ELSE 0 END, 2)::DOUBLE AS volume_z, round(CASE WHEN rs > 0 THEN coalesce(mv, 0) / rs ELSE 0 END, 2)::DOUBLE AS return_z FROM g WHERE n_base >= 5""")(
    lambda t: (lambda b: series.market_scores(b, b.groupBy("ticker").agg(F.max("day").alias("day"))).select("ticker", "n_base", "volume_z", "return_z"))(t("lineitem").groupBy(C("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))))
query("w03_gap_uniformity", "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM events) SELECT user_id, count(*) AS n, round(median(g), 3) AS median, round(stddev_pop(g) / avg(g), 4) AS cv FROM g GROUP BY user_id HAVING count(*) >= 6")(
    lambda t: series.gap_uniformity(t("events").withColumn("ts", C("ts").cast("timestamp")), "user_id", "ts").select("user_id", "n", F.round("median", 3).alias("median"), F.round("cv", 4).alias("cv")))
query("w04_escalation", "WITH g AS (SELECT user_id, event_id, value, value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS rise FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (rise) AS rises, count(*) FILTER (rise) >= 0.5 * (count(*) - 1) AND arg_max(value, event_id) > arg_min(value, event_id) AS escalates FROM g GROUP BY user_id HAVING count(*) >= 3")(
    lambda t: series.escalation(t("events"), "user_id", "event_id", "value", 3, 0.5).select("user_id", "n", "rises", "escalates"))
query("w06_resurfacing", "WITH g AS (SELECT o_custkey, o_orderdate, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)::DATE, o_orderdate::DATE) AS gap_days FROM orders) SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, gap_days::INT AS gap_days FROM g WHERE gap_days >= 14")(
    lambda t: series.resurfacing(t("orders"), "o_custkey", "o_orderdate").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "gap_days"))
query("w07_rank_candidates", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey) AS n FROM lineitem) WHERE n = 1")(
    lambda t: rollups.latest(t("lineitem"), ["l_orderkey"], [F.desc("l_quantity"), F.desc("l_extendedprice"), C("l_partkey")]).select("l_orderkey", "l_partkey"))
query("w09_stride", "WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) SELECT c_custkey FROM r, n WHERE i = 0 OR floor(i / greatest(n / 50.0, 1.0)) <> floor((i - 1) / greatest(n / 50.0, 1.0))")(
    lambda t: series.stride(t("customer"), "c_custkey", 50).select("c_custkey"))
query("w10_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")(
    lambda t: boards.percentiles(t("events"), "event_type", "value", p50=0.5, p95=0.95))
query("p02_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events")(
    lambda t: series.rate(t("events").withColumn("ts", C("ts").cast("timestamp")), "user_id", "ts", 3600).select("event_id", "hits"))
query("t01_page_of_messages", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 10")(
    lambda t: boards.page(t("events").select("event_id", "user_id"), [F.desc("event_id")], 50, 10))
query("t04_dedupe_by_url", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")(lambda t: rollups.latest(t("pages"), ["url"], [C("page_id")]).select("url", "page_id"))
query("t05_reason_sort", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place FROM events")(
    lambda t: boards.in_order(t("events"), "user_id", F.desc("value"), C("event_id")).select("user_id", "event_id", "place"))
query("k03_insert_new", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")(
    lambda t: rollups.insert_new(t("customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), t("customer").filter("c_custkey % 3 = 0").select("c_custkey", "c_name"), "c_name"))
query("k05_update", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")(
    lambda t: rollups.update(t("customer").select("c_custkey", "c_mktsegment"), t("customer").filter("c_custkey % 5 = 0").select("c_custkey", F.lit("X").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"]))
query("k08_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY ORDER BY event_id DESC LIMIT 500")(
    lambda t: rollups.retain(t("events").join(t("events").agg(F.max("ts").alias("now"))), "ts", "event_id", C("now"), 3, 500).select("event_id"))

query("m01_tfidf_pairs", r"""WITH b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS token FROM b), tf AS (SELECT item_id, token, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
r AS (SELECT item_id, token, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)), n AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM r)
SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS score FROM n a JOIN n b ON a.token = b.token AND a.item_id < b.item_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.3""")(
    lambda t: similar.similar_pairs(similar.tfidf(t("benchmark"), "item_id", "text"), "item_id", 0.3).select("a", "b", F.round("score", 6).alias("score")))
query("m02_components", """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * 7 % 60 AS b FROM supplier WHERE s_suppkey % 4 > 0), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.id = u.a) SELECT id, min(c) AS component FROM r GROUP BY id""")(
    lambda t: similar.connected(t("supplier").filter("s_suppkey % 4 > 0").select(C("s_suppkey").alias("a"), (C("s_suppkey") * 7 % 60).alias("b")).filter("a <> b")))
query("m04_nearest", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings WHERE query_id <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, score, place::INT AS place FROM r WHERE place <= 5")(
    lambda t: similar.nearest(t("embeddings").select("vec_id", "embedding"), t("embeddings").filter("vec_id % 20 = 0").select("vec_id", "embedding"), 5))
query("m07_bigram_score", "WITH g AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2)) AS x, list_transform(range(1, length(p_type)), lambda i: substr(lower(p_type), i, 2)) AS y FROM part) SELECT p_partkey, round(CASE WHEN a = b THEN 100.0 ELSE coalesce(200.0 * list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda u: u = g)), len(list_filter(y, lambda u: u = g))))) / nullif(len(x) + len(y), 0), 0) END, 4)::DOUBLE AS score FROM g")(lambda t: similar.bigram_score(t("part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type").select("p_partkey", F.round("score", 4).alias("score")))
