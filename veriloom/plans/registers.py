"""Queries of registers: numbers, names, domains, contacts and notices, with suppliers, nations and page hosts as registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import text, urls
from veriloom.operators import registers
from veriloom.plans.base import query

C = F.col
HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
SITE = r"regexp_extract({0}, '([^.]+\.[^.]+)$', 1)"
SALT = b"salt of the register"


def pick(n, *values):
    """One of some values by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def values(t, kind: str, rows: list):
    return t.spark.createDataFrame(rows, kind)


query("j13_by_number", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'XX' ELSE 'INZ' END || lpad((o_custkey % 160)::VARCHAR, 9, '0') AS number, o_custkey % 160 AS n, CASE o_orderkey % 3 WHEN 0 THEN 'supplier ' || lpad((o_custkey % 160)::VARCHAR, 9, '0') WHEN 1 THEN 'supplier' ELSE 'customer 7' END AS said, o_orderstatus FROM orders)
SELECT o_orderkey, number, s_name AS registered, CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN s_suppkey IS NULL THEN 'absent' WHEN s_acctbal <= 0 THEN 'unverified' WHEN said = 'supplier ' || lpad(n::VARCHAR, 9, '0') THEN 'valid' WHEN said = 'supplier' THEN 'weak_match' ELSE 'collision' END AS state FROM c LEFT JOIN supplier ON s_suppkey = n AND o_orderstatus <> 'P'""")(
    lambda t: registers.by_number(t("orders").select("o_orderkey", F.concat(F.when(C("o_orderstatus") == "P", "XX").otherwise("INZ"), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0")).alias("number"), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("Supplier "), F.lpad((C("o_custkey") % 160).cast("string"), 9, "0"), F.lit(" Pvt Ltd"))).when(C("o_orderkey") % 3 == 1, "Supplier Limited").otherwise("Customer 7").alias("said")), "number", t("supplier").select(F.concat(F.lit("inz"), F.lpad(C("s_suppkey").cast("string"), 9, "0")).alias("no"), "s_name", (C("s_acctbal") > 0).alias("active")), "no", "s_name", "active", "said").drop("said"))
query("u28_authority", rf"""WITH h AS (SELECT page_id, regexp_replace({HOST}, '^www\.', '') AS host FROM pages), l AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS listed FROM h WHERE page_id % 3 = 0), f AS (SELECT page_id, host, listed, row_number() OVER (PARTITION BY page_id ORDER BY length(listed) DESC NULLS LAST) AS k FROM h LEFT JOIN l ON host = listed OR ends_with(host, '.' || listed))
SELECT page_id, CASE WHEN ends_with(host, '.example.net') THEN 'RESTRICTED' WHEN host = listed THEN 'EXACT' WHEN listed IS NOT NULL THEN 'PARENT' END AS how, nullif(listed, '') AS matched, upper(nullif(listed, '')) AS entity FROM f WHERE k = 1""")(
    lambda t: registers.authority(t("pages").select("page_id", urls.host(C("url")).alias("host")), "host", t("pages").filter("page_id % 3 = 0").select(F.regexp_extract(text.domain(urls.host(C("url"))), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("host")).distinct().withColumn("entity", F.upper("host")), ("example.net",)).drop("host"))
query("u30_aligned", rf"SELECT page_id, page_id % 4 <> 0 AND {SITE.format(HOST)} = CASE WHEN page_id % 2 = 0 THEN 'example.com' ELSE {SITE.format(HOST)} END AS out FROM pages")(
    lambda t: t("pages").select("page_id", registers.aligned(F.when(C("page_id") % 4 != 0, urls.host(C("url"))), F.when(C("page_id") % 2 == 0, "mail.example.com").otherwise(F.concat(F.lit("news."), urls.host(C("url"))))).alias("out")))
query("j24_source_tier", rf"""WITH l(host, tier, r) AS (VALUES ('example.com', 'caution', 1), ('example.net', 'unreliable', 2), ('spam-farm.example.org', 'unreliable', 2), ('m.example.net', 'trusted', 0), ('blog.thththe.example.com', 'trusted', 0)), p AS (SELECT page_id, {HOST} AS h FROM pages), f AS (SELECT page_id, tier, row_number() OVER (PARTITION BY page_id ORDER BY r NULLS LAST) AS k FROM p LEFT JOIN l ON h = host OR ends_with(h, '.' || host))
SELECT page_id, coalesce(tier, 'unknown') AS tier, CASE tier WHEN 'trusted' THEN 30 WHEN 'caution' THEN 0 WHEN 'unreliable' THEN -30 ELSE -10 END AS change FROM f WHERE k = 1""")(
    lambda t: registers.source_tier(t("pages").select("page_id", urls.host(C("url")).alias("h")), "h", values(t, "host string, tier string", [("example.com", "caution"), ("example.net", "unreliable"), ("spam-farm.example.org", "unreliable"), ("m.example.net", "trusted"), ("blog.thththe.example.com", "trusted")])).select("page_id", "tier", "change"))


def organisations(t):
    n = C("n_nationkey").cast("string")
    return t("nation").select(C("n_name").alias("name"), C("n_nationkey").alias("ord"), F.concat(F.lit("N"), n).alias("short_name"), F.array(F.concat(F.lit("nation-"), n, F.lit("-bank.example"))).alias("domains"), F.array(F.concat(F.lit("Mail.nation-"), n, F.lit(".example"))).alias("email_domains"), F.array(F.concat(F.lit("Nation"), n)).alias("handles"))


query("j18_trusted_source", """WITH s AS (SELECT c_custkey, c_custkey % 5 AS k, c_nationkey AS n FROM customer), d AS (SELECT DISTINCT 'nation-' || n || '-banc.example' AS domain FROM s), l AS (SELECT domain, arg_min(n_name, n_nationkey) AS name FROM d, nation WHERE levenshtein(domain, 'nation-' || n_nationkey || '-bank.example') <= 2 GROUP BY domain)
SELECT c_custkey, CASE WHEN k < 3 THEN n_name WHEN k = 3 THEN l.name END AS name, CASE k WHEN 0 THEN 'handle' WHEN 1 THEN 'email_domain' WHEN 2 THEN 'domain' WHEN 3 THEN 'lookalike' END AS how FROM s JOIN nation ON n_nationkey = n LEFT JOIN l ON domain = 'nation-' || n || '-banc.example'""")(
    lambda t: registers.trusted_source(t("customer").select("c_custkey", F.when(C("c_custkey") % 5 == 0, F.concat(F.lit("@nation"), C("c_nationkey").cast("string"))).when(C("c_custkey") % 5 == 1, F.concat(F.lit("desk@mail.Nation-"), C("c_nationkey").cast("string"), F.lit(".example"))).when(C("c_custkey") % 5 == 2, F.concat(F.lit("https://www.nation-"), C("c_nationkey").cast("string"), F.lit("-bank.example/pay"))).when(C("c_custkey") % 5 == 3, F.concat(F.lit("nation-"), C("c_nationkey").cast("string"), F.lit("-banc.example"))).otherwise("nobody.test").alias("source")), "c_custkey", C("source"), organisations(t)).select("c_custkey", "name", "how"))
query("j19_organisation_named", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'NATION_' || c_nationkey END AS name FROM customer WHERE c_custkey % 3 < 2")(
    lambda t: registers.organisation_named(t("customer").select("c_custkey", F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("the desk of Nation_"), C("c_nationkey").cast("string"), F.lit(", writing to you"))).when(C("c_custkey") % 3 == 1, F.concat(F.lit(" n"), C("c_nationkey").cast("string"))).otherwise("somebody else").alias("said")), "c_custkey", "said", organisations(t)))
query("j09_resolved_company", "SELECT c_custkey, s_name AS registered, 100.0::DOUBLE AS score FROM customer JOIN supplier ON s_suppkey = c_custkey % 97 WHERE c_custkey % 2 = 0 AND s_acctbal > 0")(
    lambda t: registers.resolved_company(t("customer").select("c_custkey", F.when(C("c_custkey") % 2 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((C("c_custkey") % 97).cast("string"), 9, "0"), F.lit(" Limited"))).otherwise("Zyx").alias("name")).join(t("supplier").filter("s_acctbal > 0").select(C("s_suppkey").alias("k")), C("k") == C("c_custkey") % 97).drop("k"), "c_custkey", "name", t("supplier").select(C("s_name").alias("registered"), (C("s_acctbal") > 0).alias("listed"))))
query("j12_several_companies", r"""WITH n(name) AS (VALUES ('the'), ('of the'), ('and'), ('der'), ('und der'), ('que la'), ('la')), d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9#]+', ' ', 'g')) || ' ' AS w, len(list_distinct(regexp_extract_all(text, '[0-9]{16}')))::INT AS ids FROM documents),
f AS (SELECT doc_id, name FROM d, n WHERE contains(w, ' ' || name || ' ')), a AS (SELECT doc_id, count(*)::INT AS names FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.name <> f.name AND contains(g.name, f.name)) GROUP BY doc_id)
SELECT doc_id, ids, coalesce(names, 0)::INT AS names, ids >= 2 OR coalesce(names, 0) >= 2 AS several FROM d LEFT JOIN a USING (doc_id)""")(
    lambda t: registers.several_companies(t("documents"), "doc_id", "text", values(t, "name string, normalised string", [(x, x) for x in ("the", "of the", "and", "der", "und der", "que la", "la")]), "[0-9]{16}"))
query("j22_contact_state", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'match' ELSE 'mismatch' END AS state FROM customer")(
    lambda t: t("customer").select("c_custkey", registers.contact_state(F.concat(F.lit(" "), "c_name", F.lit("@Mail.example ")), F.when(C("c_custkey") % 3 == 1, text.keyed_digest(F.lower(F.concat("c_name", F.lit("@mail.example"))), SALT)).when(C("c_custkey") % 3 == 2, text.keyed_digest(C("c_name"), SALT)), SALT, "email").alias("state")))
query("j23_notice_state", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 AND o_orderkey % 3 <> 0 THEN 'exact' WHEN o_orderkey % 4 < 3 THEN 'reference' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'outside_coverage' ELSE 'not_in_index' END AS state FROM orders""")(
    lambda t: registers.notice_state(t("orders").select("o_orderkey", F.concat(F.lit("sebi / ho / "), C("o_orderkey").cast("string")).alias("number"), F.when(C("o_orderkey") % 3 == 0, "Something else").otherwise(F.concat(F.lit("Notice to "), C("o_custkey").cast("string"), F.lit("!"))).alias("body"), "o_orderdate"), "number", "body", "o_orderdate", t("orders").filter("o_orderkey % 4 < 3").select(F.concat(F.lit("SEBI/HO/"), C("o_orderkey").cast("string")).alias("reference"), F.sha2(F.concat(F.lit("notice to "), C("o_custkey").cast("string")), 256).alias("body_hash")), F.to_timestamp(F.lit("1996-01-01"))).select("o_orderkey", "state"))
query("j26_best_entry", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 5000)::INT DESC, (c_mktsegment = 'BUILDING')::INT DESC, c_custkey) AS k FROM customer) WHERE k = 1")(
    lambda t: registers.best_entry(t("customer").select("c_nationkey", "c_custkey", F.when(C("c_acctbal") > 5000, C("c_name")).alias("contact"), F.when(C("c_mktsegment") == "BUILDING", C("c_name")).alias("number")), "c_nationkey", ["contact", "number"], "c_custkey").select("c_nationkey", "c_custkey"))
query("v11_namespace", "SELECT c_custkey, c_custkey % 2 = 0 AS inside, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN ['', 'brk', 'mf'][(c_custkey % 3 + 1)::INT] END AS code, c_custkey % 2 = 0 AND c_custkey % 3 = 2 AS clash FROM customer")(
    lambda t: t("customer").select("c_custkey", registers.namespace_state(F.concat(F.lit("abc"), C("c_custkey").cast("string"), pick(C("c_custkey"), "", ".brk", ".MF"), pick(C("c_custkey"), "@validhdfc", "@okaxis")), listed=("validhdfc", "validsbi"), claimed=F.lit("BRK")).alias("s")).select("c_custkey", "s.*"))
query("v09_recognition_family", "WITH n AS (SELECT upper(s_name) AS c FROM supplier UNION ALL SELECT upper(substr(c_name, 1, 12 + c_custkey % 3)) FROM customer) SELECT regexp_extract(c, '^[A-Z]+') AS stem, count(*) AS n, min(length(regexp_replace(c, '[^0-9]', '', 'g')))::INT AS least_digits, max(length(regexp_replace(c, '[^0-9]', '', 'g')))::INT AS most_digits, array_to_string(list_sort(list(DISTINCT length(c))), ',') AS lengths FROM n GROUP BY 1")(
    lambda t: registers.recognition_family(t("supplier").select(C("s_name").alias("c")).unionByName(t("customer").select(F.expr("substring(c_name, 1, cast(12 + c_custkey % 3 as int))").alias("c"))), "c").withColumn("lengths", F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",")))
query("v07_prefix", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'INZ' WHEN 1 THEN 'IN-DP' ELSE '' END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", registers.checks.prefix(F.concat(pick(C("o_orderkey"), "inz", "in-dp-", "9"), C("o_custkey").cast("string"))).alias("out")))
query("z32_entity_in_message", r"""WITH d AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9#]+', ' ', 'g')) || ' ' AS w FROM documents), n(name, norm) AS (VALUES ('Of The', 'of the'), ('The', 'the'), ('Und Der', 'und der'), ('Que', 'que')), f AS (SELECT doc_id, max_by(name, struct_pack(l := length(name), n := name)) AS name FROM d, n WHERE contains(w, ' ' || norm || ' ') GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Acme Bank' WHEN name IS NOT NULL THEN name WHEN source IN ('src1', 'src2', 'src3') THEN upper(source) END AS entity, CASE WHEN doc_id % 5 = 0 THEN 'display' WHEN name IS NOT NULL THEN 'text' WHEN source IN ('src1', 'src2', 'src3') THEN 'domain' END AS by FROM d LEFT JOIN f USING (doc_id)""")(
    lambda t: registers.entity_in_message(t("documents").select("doc_id", "text", F.concat("source", F.lit(".Example")).alias("domain"), F.when(C("doc_id") % 5 == 0, "Acme Bank - Support Desk").otherwise("").alias("display")), "doc_id", C("display"), "text", "domain", values(t, "name string, normalised string", [("Of The", "of the"), ("The", "the"), ("Und Der", "und der"), ("Que", "que")]), values(t, "domain string, entity string", [(f"src{i}.example", f"SRC{i}") for i in (1, 2, 3)])))
query("z31_owns", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", registers.owns(F.when(C("c_custkey") % 4 != 0, C("c_name")), F.concat(F.lit("Pay"), C("c_custkey").cast("string")), F.array(F.when(C("c_custkey") % 4 == 1, F.concat(F.lit("PAY"), C("c_custkey").cast("string"))).otherwise("other"))).alias("out")))
