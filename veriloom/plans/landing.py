"""Queries of sources and sinks: what is landed in the shared folder is read again by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import text
from veriloom.operators import rollups
from veriloom.plans.base import query
from veriloom.sources import readers
from veriloom.sources.shared import land

C = F.col
NAME = "trim(regexp_replace(trim(regexp_replace(replace(lower(trim({0})), '#', ' '), '\\s+', ' ', 'g')), '(?: (?:private limited|public limited|pvt ltd|pvt limited|limited|ltd|llp|inc|india))+$', ''))"

query("s01_filings", """SELECT 'F' || doc_id AS source_id, CASE WHEN contains(lower(text), 'dividend') THEN 'DIVIDEND' WHEN contains(lower(text), 'agm') THEN 'AGM' ELSE 'X' END <> 'X' AS typed, (length(text) + CASE WHEN doc_id % 3 = 0 THEN 1 + length(source) ELSE 0 END)::INT AS n FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0""")(
    lambda t: readers.filings(t.spark, land(t("documents").select(F.when(C("doc_id") % 10 != 0, F.concat(F.lit("F"), C("doc_id").cast("string"))).otherwise(" ").alias("source_id"), C("text").alias("body_text")), "json"), known=t("documents").filter("doc_id % 7 = 0").select(F.concat(F.lit("F"), C("doc_id").cast("string")).alias("source_id")), texts=t("documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("F"), C("doc_id").cast("string")).alias("source_id"), C("source").alias("text"))).select("source_id", C("doc_type").isin("DIVIDEND", "AGM").alias("typed"), F.length("body_text").alias("n")))
query("s02_companies", "SELECT DISTINCT lower(p_brand) AS normalised, p_type AS type FROM part")(
    lambda t: readers.companies(t.spark, land(t("part").select(F.concat("p_brand", F.lit(" Pvt Ltd")).alias("name"), C("p_type").alias("type")), "csv", header=True)).select(F.regexp_replace("normalised", " ", "#").alias("normalised"), "type").distinct())
query("s03_intermediaries", "SELECT 'INZ' || s_suppkey AS reg_no, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'firm' || s_suppkey || '.example' END AS official_domain FROM supplier")(
    lambda t: readers.intermediaries(t.spark, land(t("supplier").select(F.concat(F.lit("INZ"), C("s_suppkey").cast("string")).alias("reg_no"), F.when(C("s_suppkey") % 3 == 0, "desk@gmail.com").otherwise(F.concat(F.lit("desk@Firm"), C("s_suppkey").cast("string"), F.lit(".example"))).alias("email")), "json")).select("reg_no", "official_domain"))
query("s04_domain_map", "SELECT DISTINCT 'nation' || c_nationkey || '.example' AS domain, 'NATION_' || c_nationkey AS entity_name FROM customer")(
    lambda t: readers.domain_map(t.spark, land(t("customer").select(F.concat(F.lit("https://www.Nation"), C("c_nationkey").cast("string"), F.lit(".example/")).alias("domain"), F.concat(F.lit("NATION_"), C("c_nationkey").cast("string")).alias("entity_name")), "csv", header=True)))
query("s05_claim_rules", "SELECT p_partkey::VARCHAR AS code, p_name AS pattern FROM part WHERE p_partkey % 3 > 0")(
    lambda t: readers.csv_pack(t.spark, land(t("part").select(C("p_partkey").alias("code"), F.when(C("p_partkey") % 3 > 0, C("p_name")).otherwise(" ").alias("pattern")), "csv", header=True), ["code", "pattern"]))
query("s07_handle_rules", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'BANK' WHEN c_custkey % 4 = 1 THEN 'WALLET' WHEN c_custkey % 4 = 2 THEN 'NUMBERED' ELSE 'UNKNOWN' END AS category, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS severity FROM customer")(
    lambda t: readers.classify_handles(t("customer").select("c_custkey", F.concat(F.when(C("c_custkey") % 4 == 2, "99").otherwise("Name"), F.element_at(F.array(*map(F.lit, ("@OkBank", "@paywallet", "@other", "@none"))), (C("c_custkey") % 4 + 1).cast("int"))).alias("handle")), "c_custkey", "handle", readers.handle_rules(t.spark, land(t.spark.createDataFrame([(1, "@okbank", "suffix", "BANK", "1"), (2, "paywallet", "SUFFIX", "WALLET", "3"), (3, "^[0-9]+@", "regex", "NUMBERED", "2"), (4, "^[0-9]+@other", "REGEX", "LATER", "5"), (5, None, "REGEX", "NONE", "5")], "ord int, pattern string, match_type string, category string, severity string"), "csv", header=True))).select("c_custkey", "category", "severity"))
query("s08_bank_codes", "SELECT upper(substr(s_name, 1, 3)) || s_nationkey AS ifsc_prefix, min(s_name) AS bank_name FROM supplier GROUP BY 1")(
    lambda t: readers.bank_codes(t.spark, land(t("supplier").select(F.concat(F.lit(" "), F.lower(F.substring("s_name", 1, 3)), C("s_nationkey").cast("string")).alias("ifsc_prefix"), C("s_name").alias("bank_name")), "csv", header=True)).select("ifsc_prefix", "bank_name"))
query("s09_aliases", "SELECT 'sup ' || s_suppkey AS alias, 'supplier ' || s_suppkey AS registered FROM supplier WHERE s_acctbal > 0")(
    lambda t: readers.aliases(t.spark, land(t("supplier").select(F.concat(F.lit("Sup "), C("s_suppkey").cast("string"), F.lit(" Ltd")).alias("alias"), F.concat(F.lit("Supplier "), C("s_suppkey").cast("string"), F.lit(" Limited")).alias("entity_name")), "csv", header=True), t("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier "), C("s_suppkey").cast("string")).alias("registered")).withColumn("normalised", text.company_name(C("registered")))))
query("s12_behaviour_pack", "SELECT event_type AS id, (10 * length(event_type))::INT AS weight, count(*) AS n FROM (SELECT DISTINCT event_type FROM events), (VALUES (1), (2)) GROUP BY ALL")(
    lambda t: readers.behaviour_pack(t.spark, land(t("events").select("event_type").distinct().agg(F.collect_list(F.struct(C("event_type").alias("id"), (10 * F.length("event_type")).alias("weight"), F.array(C("event_type"), F.lit("x")).alias("patterns"))).alias("tactics")), "json")).select("id", "weight", F.size("patterns").cast("long").alias("n")))
query("s13_trusted_register", "SELECT n_name AS name, 'nation' || n_nationkey || '.example' AS domain FROM nation")(
    lambda t: readers.organisations(t.spark, land(t("nation").agg(F.collect_list(F.struct(C("n_name").alias("name"), F.array(F.concat(F.lit("Nation"), C("n_nationkey").cast("string"), F.lit(".Example"))).alias("domains"), F.lit(None).cast("array<string>").alias("email_domains"), F.lit(None).cast("array<string>").alias("handles"))).alias("organisations")), "json", ignoreNullFields=False)).select("name", F.explode("domains").alias("domain")))
query("s24_bars", "SELECT 'T' || l_suppkey || '.NS' AS ticker, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")(
    lambda t: readers.bars(t.spark, land(t("lineitem").select(F.concat(F.lit("T"), C("l_suppkey").cast("string"), F.when(C("l_linenumber") > 3, ".NS").otherwise("")).alias("ticker"), C("l_extendedprice").alias("close")), "csv", header=True)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total")))
query("s25_url_corpus", "SELECT url, 1 - (page_id % 2) AS y FROM pages WHERE page_id % 5 > 0")(
    lambda t: readers.url_corpus(t.spark, land(t("pages").select(F.when(C("page_id") % 5 > 0, C("url")).alias("url"), (C("page_id") % 2).alias("label")), "parquet")).select("url", "y"))
query("s26_harvest", "SELECT 'INZ' || c_custkey AS number, c_name AS name, DATE '2020-01-01' AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-12-31' END AS valid_to FROM customer")(
    lambda t: readers.harvest(t.spark, land(t("customer").select(F.concat(F.lit("INZ"), C("c_custkey").cast("string")).alias("number"), F.explode(F.array(F.struct(F.lit("old name").alias("name"), F.lit(1).alias("landed")), F.struct(C("c_name").alias("name"), F.lit(2).alias("landed")))).alias("x"), F.when(C("c_custkey") % 2 == 0, "01-Jan-2020 to 31-Dec-2024").otherwise("01-Jan-2020 - Perpetual").alias("validity")).select("number", "x.*", "validity"), "json")))
query("s27_minimise", "SELECT c_custkey, 'nation' || c_nationkey || '.example' AS domain_anchor FROM customer")(
    lambda t: readers.minimise(t("customer").select("c_custkey", C("c_name").alias("phone"), F.concat(F.lit("http://WWW.nation"), C("c_nationkey").cast("string"), F.lit(".example/x")).alias("website")), ["phone", "website"]))
query("s28_refresh", "SELECT 'feed' || doc_id AS feed, CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN strlen(text) > 2000 THEN 'truncated' WHEN strlen(text) = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE least(strlen(text), 2000) END::BIGINT AS bytes FROM documents")(
    lambda t: readers.refreshed(t("documents").select(F.concat(F.lit("feed"), C("doc_id").cast("string")).alias("feed"), F.when(C("doc_id") % 9 != 0, C("text")).alias("content")), 2000))
query("k01_persist", r"SELECT doc_id AS msg_id, 'upload' AS channel, CASE WHEN doc_id % 2 = 0 THEN 'host' || doc_id || '.example' END AS top_domain, len(list_slice(range(doc_id % 30), 1, 20))::INT AS codes FROM documents")(
    lambda t: t.spark.read.parquet(land(rollups.fact_rows(t("documents").select(C("doc_id").alias("msg_id"), F.current_timestamp().alias("created_at"), F.lit("upload").alias("channel"), F.lit("GENUINE").alias("verdict"), F.when(C("doc_id") % 2 == 0, F.array(F.concat(F.lit("https://Host"), C("doc_id").cast("string"), F.lit(".example/a")), F.lit("x.example"))).otherwise(F.array().cast("array<string>")).alias("urls"), F.when(C("doc_id") % 30 > 0, F.transform(F.sequence(F.lit(1), C("doc_id") % 30), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>")).alias("codes"))), "parquet")).select("msg_id", "channel", "top_domain", F.size("reason_codes").alias("codes")))
query("k06_observation", """WITH o AS (SELECT user_id AS id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS k FROM events) SELECT 'observations' AS name, count(*) AS n FROM o WHERE k = 1 UNION ALL SELECT 'sightings', 2 * count(*) FROM o WHERE k = 1 UNION ALL SELECT 'reasons', count(*) FROM o WHERE k = 1 AND value > 10""")(
    lambda t: (lambda parts: parts["observations"].agg(F.lit("observations").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(parts["sightings"].agg(F.lit("sightings").alias("name"), F.count(F.lit(1)).alias("n"))).unionByName(parts["reasons"].agg(F.lit("reasons").alias("name"), F.count(F.lit(1)).alias("n"))))(rollups.observation_tables(t("events").select(C("user_id").alias("id"), C("ts").alias("observed_at"), C("event_type").alias("channel"), F.array(F.struct(F.lit("type").alias("type"), C("event_type").alias("value")), F.struct(F.lit("k").alias("type"), C("props").alias("value")), F.struct(F.lit("type").alias("type"), C("event_type").alias("value"))).alias("entities"), F.when(C("value") > 10, F.array(F.lit("HIGH"))).otherwise(F.array().cast("array<string>")).alias("reasons")))))
query("k07_load_reference", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer")(
    lambda t: rollups.replaced(t("customer").select("c_custkey", "c_name"), t("customer").filter("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(F.concat(F.lit("a "), "c_name"), F.concat(F.lit("new "), "c_name"))).alias("c_name")), "c_custkey"))
