"""Queries of scalar functions: normalisation, URLs, entities, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import checks, entities, text, urls
from veriloom.operators import boards
from veriloom.plans.base import query

C = F.col
HIDDEN = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
ALIKE = "'" + "".join(text.LOOKALIKES) + "', '" + "".join(text.LOOKALIKES.values()) + "'"
MATCHING = rf"lower(trim(regexp_replace(translate(regexp_replace(nfc_normalize(text), '{HIDDEN}', '', 'g'), {ALIKE}), '\s+', ' ', 'g')))"
HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
SECOND = "(" + ", ".join(f"'{s}'" for s in urls.SECOND_LEVEL) + ")"


def tail_sql(h: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({h}, '.'), -{n}, -1), '.')"


def texts(name: str, expr, sql: str):
    query(name, f"SELECT doc_id, {sql} AS out FROM documents")(lambda t: t("documents").select("doc_id", expr(C("text")).alias("out")))


def pages(name: str, expr, sql: str, pre: str = ""):
    query(name, f"{pre} SELECT page_id, {sql} AS out FROM pages")(lambda t: t("pages").select("page_id", expr(C("url")).alias("out")))


texts("n01_strip_invisible", lambda c: F.length(text.strip_invisible(c)).cast("long"), f"length(regexp_replace(text, '{HIDDEN}', '', 'g'))")
# letters of other scripts are put in first: folded, the text is what it was
texts("n02_fold_lookalikes", lambda c: F.sha2(text.fold_lookalikes(F.translate(c, "aceopxyBHKMijsSTvE", "ａсｅｏрхуВНКМіјѕЅТνΕ")), 256), "sha256(text)")
texts("n03_for_matching", lambda c: F.sha2(text.for_matching(c), 256), f"sha256({MATCHING})")
texts("n08_bare", lambda c: F.sha2(text.bare(c), 256), rf"sha256(regexp_replace({MATCHING}, '[\s._\-]+', '', 'g'))")
query("n04_company_name", r"""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(replace(lower(trim(p_name)) || CASE p_partkey % 4 WHEN 0 THEN ' pvt ltd' WHEN 1 THEN ' limited india' WHEN 2 THEN ' & sons llp' ELSE ' corporation' END, '&', ' and '), '\s+', ' ', 'g')), '(?: (?:private limited|public limited|pvt ltd|pvt\. ltd\.|pvt limited|limited|ltd|ltd\.|llp|inc|incorporated|plc|india|of india))+$', '')) AS out FROM part""")(
    lambda t: t("part").select("p_partkey", text.company_name(F.concat("p_name", F.when(C("p_partkey") % 4 == 0, " Pvt Ltd").when(C("p_partkey") % 4 == 1, " Limited India").when(C("p_partkey") % 4 == 2, " & Sons LLP").otherwise(" Corporation"))).alias("out")))
pages("n05_domain", text.domain, r"regexp_replace(rtrim(regexp_extract(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '^[^/?#]*'), '^.*@', ''), '^[^:]*'), '.'), '^www\.', '')")
texts("n06_hash_text", lambda c: F.sha2(text.hash_text(c), 256), rf"sha256(regexp_replace({MATCHING}, '[^\p{{L}}\p{{N}}_\p{{M}}]', '', 'g'))")
texts("n07_collapse", lambda c: F.sha2(text.collapse(c), 256), r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))")
pages("n09_identity_host", lambda c: text.identity_host(urls.host(c)), rf"regexp_replace(regexp_replace({HOST}, '\.+', '.', 'g'), '^\.|\.$', '', 'g')")
query("n10_resemblance", r"SELECT doc_id, regexp_replace(lower(strip_accents(regexp_replace(trim(regexp_replace(text, '\.+', '.', 'g')), '^\.|\.$', '', 'g'))), '[^a-z0-9.]', '', 'g') AS out FROM documents")(
    lambda t: t("documents").select("doc_id", text.resemblance_host(C("text")).alias("out")))
query("n11_obfuscation", f"SELECT doc_id, len(regexp_extract_all(text, '{HIDDEN}'))::INT AS hidden, len(regexp_extract_all(text, '[{''.join(text.LOOKALIKES)}]'))::INT AS lookalikes, len(regexp_extract_all(text, '[！-～]'))::INT AS wide, regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[Ͱ-ϿЀ-ӿ]') AS mixed FROM documents")(
    lambda t: t("documents").select("doc_id", text.obfuscation(C("text")).alias("o")).select("doc_id", "o.*"))
texts("n12_fold_wide", lambda c: F.sha2(text.fold_wide(c), 256), "sha256(translate(text, '" + text.WIDE[0] + "', '" + text.WIDE[1].replace("'", "''") + "'))")
query("n13_reference", r"SELECT o_orderkey, trim(upper(regexp_replace('/' || lower(o_orderpriority) || ' / ' || o_orderkey || '/', '\s+', '', 'g')), '/') AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", text.reference(F.concat(F.lit("/"), F.lower("o_orderpriority"), F.lit(" / "), C("o_orderkey").cast("string"), F.lit("/"))).alias("out")))
texts("n14_notice_hash", text.notice_hash, "sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))")
query("n15_register_name", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' Company Pvt Ltd'), '\b(private|pvt|public|limited|ltd|llp|inc|plc|company|co|corporation|corp)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", text.register_name(F.concat("c_name", F.lit(" Company Pvt Ltd"))).alias("out")))
query("n16_email_phone", r"SELECT c_custkey, lower(trim(' ' || c_name || '@Mail.example ')) AS email, right(regexp_replace('+91-' || (9000000000 + c_custkey), '\D', '', 'g'), 10) AS phone FROM customer")(
    lambda t: t("customer").select("c_custkey", text.email(F.concat(F.lit(" "), "c_name", F.lit("@Mail.example "))).alias("email"), text.phone10(F.concat(F.lit("+91-"), (F.lit(9000000000) + C("c_custkey")).cast("string"))).alias("phone")))
_KEY = b"salt-of-tests".ljust(64, b"\x00")
_HEX = {k: "".join(f"\\x{x ^ v:02X}" for x in _KEY) for k, v in (("inner", 0x36), ("outer", 0x5C))}
query("n17_keyed_digest", f"SELECT c_custkey, substr(sha256('{_HEX['outer']}'::BLOB || unhex(sha256('{_HEX['inner']}'::BLOB || encode(c_name)))), 1, 32) AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", text.keyed_digest(C("c_name"), b"salt-of-tests").alias("out")))
query("n18_tiers", "SELECT c_custkey, c_mktsegment, sha256(c_name) AS name_anchor FROM customer")(
    lambda t: boards.tiers(t("customer"), ["c_custkey", "c_mktsegment"], ["c_name"]).withColumnRenamed("c_name_anchor", "name_anchor"))
query("n19_fnv1a", "SELECT p_partkey, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0') AS out FROM part")(
    lambda t: t("part").select("p_partkey", text.fnv1a(C("p_name")).alias("out")))
query("n20_campaign_id", "SELECT user_id, 'cmp_' || substr(sha256(array_to_string(list_sort(list(DISTINCT 'type:' || event_type)), '|')), 1, 16) AS out FROM events GROUP BY user_id")(
    lambda t: t("events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit("type:"), "event_type")).alias("e")).select("user_id", text.campaign_id(C("e")).alias("out")))
texts("n21_message_id", lambda c: text.message_id(c, "gateway.example"), "substr(sha256(text), 1, 32) || '@gateway.example'")
pages("n22_letter_skeleton", lambda c: text.letter_skeleton(urls.host(c)), f"regexp_replace(translate(replace(replace({HOST}, 'rn', 'm'), 'vv', 'w'), '015', 'ols'), '[^a-z]', '', 'g')")
pages("n23_registry_skeleton", lambda c: text.registry_skeleton(urls.host(c)), f"translate({HOST}, '0153@$-.', 'olseas')")
pages("n24_registry_domain", text.registry_domain, r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]*)', 1), '^www\.', '')")
query("n25_joined", "SELECT c.conv_id, c.turn, array_to_string(list_filter([nullif(trim(c.role), 'system'), nullif(trim(c.text), '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS out FROM conversations c")(
    lambda t: t("conversations").select("conv_id", "turn", text.joined(F.nullif(C("role"), F.lit("system")), C("text")).alias("out")))
texts("n26_redact", lambda c: F.sha2(text.redact(c), 256), r"sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '[email]', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '[phone]', 'g'))")
query("n27_host_suffixes", f"WITH h AS (SELECT page_id, string_split({HOST}, '.') AS p FROM pages), g AS (SELECT page_id, p, unnest(generate_series(1, len(p))) AS k FROM h) SELECT page_id, array_to_string(list_slice(p, k, len(p)), '.') AS suffix FROM g")(
    lambda t: t("pages").select("page_id", F.explode(text.host_suffixes(urls.host(C("url")))).alias("suffix")))
texts("n28_truncate", lambda c: F.substring(c, 1, 280), "substr(text, 1, 280)")

pages("u02_safe_domain", urls.safe_domain, f"CASE WHEN {tail_sql(HOST, 1)} IN ('com', 'org', 'net', 'in', 'uk') OR {tail_sql(HOST, 2)} IN {SECOND} THEN CASE WHEN {tail_sql(HOST, 2)} IN {SECOND} THEN {tail_sql(HOST, 3)} ELSE {tail_sql(HOST, 2)} END END")
query("u03_public_suffix", f"SELECT page_id, {tail_sql(HOST, 1)} AS suffix, {tail_sql(HOST, 2)} AS domain, (len(string_split({HOST}, '.')) - 2)::INT AS subdomains FROM pages")(
    lambda t: t("pages").select("page_id", urls.site(urls.host(C("url"))).alias("s")).select("page_id", "s.suffix", "s.domain", "s.subdomains"))
query("u05_same_site", f"SELECT page_id, {tail_sql(HOST, 2)} = 'example.com' AS out FROM pages")(lambda t: t("pages").select("page_id", urls.same_site(urls.host(C("url")), F.lit("www.example.com")).alias("out")))
pages("u06_plain_registrable", lambda c: urls.plain_registrable(urls.host(c)), f"CASE WHEN {tail_sql(HOST, 2)} IN {SECOND} THEN {tail_sql(HOST, 3)} ELSE {tail_sql(HOST, 2)} END")
pages("u07_without_www", lambda c: urls.without_www(urls.host(c)), rf"regexp_replace(trim({HOST}, '.'), '^www\.', '')")
query("u08_depth", f"SELECT page_id, {tail_sql(HOST, 1)} AS etld, {tail_sql(HOST, 2)} AS domain, (len(string_split({HOST}, '.')) - 2)::INT AS depth FROM pages")(
    lambda t: t("pages").select("page_id", urls.effective_tld(urls.host(C("url"))).alias("etld"), urls.registrable(urls.host(C("url"))).alias("domain"), urls.depth(urls.host(C("url"))).alias("depth")))
query("u09_licensed_namespace", r"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'bank.in' WHEN 1 THEN 'fin.in' END AS suffix, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || '.bank.in' WHEN 1 THEN lower(n_name) || '.fin.in' END AS domain FROM nation")(
    lambda t: t("nation").select("n_nationkey", urls.licensed_namespace(F.concat(F.lit("www."), F.lower("n_name"), F.when(C("n_nationkey") % 3 == 0, ".bank.in").when(C("n_nationkey") % 3 == 1, ".fin.in").otherwise(".example.in"))).alias("x")).select("n_nationkey", "x.suffix", "x.domain"))
pages("u10_heuristic_domain", urls.heuristic_domain, tail_sql(rf"regexp_replace({HOST}, '^www\.', '')", 2))
query("u11_find_urls", r"SELECT page_id, array_to_string(list_distinct(regexp_extract_all(html, 'https?://[a-z0-9.-]+')), ' ') <> '' AS has, len(regexp_extract_all(html, 'https?://[^\s<>\x22'')\]]+'))::INT AS n FROM pages")(
    lambda t: t("pages").select("page_id", (F.size(urls.stated(C("html"), "[a-z0-9.-]+")) > 0).alias("has"), F.size(urls.stated(C("html"))).alias("n")))
query("u12_parts", rf"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {HOST} AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, contains({HOST}, 'xn--') AS punycode FROM pages""")(
    lambda t: t("pages").select("page_id", urls.parts(C("url")).alias("p")).select("page_id", "p.scheme", "p.host", "p.path", "p.query", "p.fragment", "p.punycode"))
query("u13_numeric_ipv4", r"SELECT c_custkey, array_to_string([(n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255], '.') AS ip, ((n >> 24) & 255) IN (0, 10, 127) OR ((n >> 16) IN (49320, 43518)) OR ((n >> 20) = 2753) AS private FROM (SELECT c_custkey, 100000000 + c_custkey * 2654435 % 4000000000 AS n FROM customer)")(
    lambda t: t("customer").select("c_custkey", urls.numeric_ipv4((F.lit(100000000) + C("c_custkey") * 2654435 % 4000000000).cast("string")).alias("ip")).withColumn("private", urls.private_ipv4(C("ip"))))
query("u16_entropy", rf"WITH h AS (SELECT page_id, {HOST} AS h FROM pages), c AS (SELECT page_id, unnest(string_split(h, '')) AS ch, length(h) AS n FROM h), g AS (SELECT page_id, ch, count(*) / max(n) AS p FROM c GROUP BY ALL) SELECT page_id, round(-sum(p * log2(p)), 6) AS out FROM g GROUP BY page_id")(
    lambda t: t("pages").select("page_id", F.round(urls.entropy(urls.host(C("url"))), 6).alias("out")))
pages("u17_single_use_token", urls.single_use_token, r"regexp_matches(lower(url), '[?&](token|otp|session|sid|auth|code)=')")
query("u18_anchor_mismatch", f"SELECT page_id, {tail_sql(HOST, 2)} <> 'example.com' AS out FROM pages")(lambda t: t("pages").select("page_id", urls.anchor_mismatch(F.lit("Go to www.example.com now"), C("url")).alias("out")))
pages("u19_credential_in_url", urls.credential_in_url, r"regexp_matches(url, '(?i)[?&](email|user|login|account)=[^&]*(@|%40)')")
query("u20_redirect_chain", "SELECT user_id, (count(*) - 1)::INT AS hops FROM (SELECT user_id FROM events) GROUP BY user_id")(
    lambda t: t("events").groupBy("user_id").agg(F.collect_list(F.concat(F.lit("https://a.example/"), C("event_id").cast("string"))).alias("h")).select("user_id", urls.redirect_chain(C("h"))["hops"].alias("hops")))
pages("u21_should_resolve", urls.should_resolve, r"CASE WHEN regexp_matches(lower(url), '[?&](token|otp|session|sid|auth|code)=') THEN 'token' ELSE 'resolve' END")
query("u22_trusted_host", f"SELECT page_id, {HOST} IN ('example.org') OR {HOST} LIKE '%.example.org' AS out FROM pages")(
    lambda t: t("pages").select("page_id", ((urls.host(C("url")) == "example.org") | urls.host(C("url")).endswith(".example.org")).alias("out")))
pages("u23_tld_risk", lambda c: urls.tld_risk(urls.host(c)), f"CASE WHEN regexp_matches({HOST}, '\\.(xyz|top|click|loan|zip)$') THEN 'high' WHEN regexp_matches({HOST}, '\\.(info|biz|online|site|net)$') THEN 'medium' ELSE 'safe' END")
_LABEL = f"list_extract(string_split({HOST}, '.'), -2)"
pages("u24_typosquat", lambda c: urls.typosquat(urls.host(c)), "CASE " + " ".join(f"WHEN {_LABEL} <> '{b}' AND (levenshtein({_LABEL}, '{b}') <= 2 OR (contains({_LABEL}, '{b}') AND length({_LABEL}) - {len(b)} <= 4)) THEN '{b}'" for b in urls.BRANDS) + " ELSE '' END")
query("u25_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INT AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")(
    lambda t: t("nation").alias("a").join(t("nation").alias("b"), (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("d")))
pages("u26_domain_trust", urls.trust, f"greatest(0, least(100, 60 + CASE WHEN {HOST} = 'example.org' OR {HOST} LIKE '%.example.org' OR {HOST} LIKE '%exchange.example.com' THEN 30 ELSE 0 END + CASE WHEN starts_with(url, 'https://') THEN 5 ELSE -15 END + CASE WHEN {HOST} LIKE '%.net' THEN -10 ELSE 0 END + CASE WHEN len(string_split({HOST}, '.')) >= 5 THEN -20 WHEN len(string_split({HOST}, '.')) >= 4 THEN -8 ELSE 0 END + CASE WHEN length({HOST}) > 40 THEN -5 ELSE 0 END))::INT")
query("u31_status_url", "SELECT c_custkey, lower('user' || c_custkey) AS handle, (((30000000000 + c_custkey * 7919000000000) >> 22) + 1288834974657)::BIGINT AS ms FROM customer")(
    lambda t: t("customer").select("c_custkey", urls.status_url(F.concat(F.lit("https://x.com/User"), C("c_custkey").cast("string"), F.lit("/status/"), (F.lit(30000000000) + C("c_custkey") * 7919000000000).cast("string")), future=True).alias("s")).select("c_custkey", "s.handle", F.unix_millis("s.at").alias("ms")))

query("x10_contacts", r"SELECT doc_id, len(list_slice(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), 1, 10))::INT AS emails, len(list_slice(regexp_extract_all(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b'), 1, 5))::INT AS pan FROM documents")(
    lambda t: t("documents").select("doc_id", F.size(entities.contacts(C("text"))["emails"]).alias("emails"), F.size(entities.contacts(C("text"))["pan"]).alias("pan")))
texts("x12_emails", lambda c: F.array_join(entities.emails(c), " "), r"coalesce(array_to_string(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), ' '), '')")
texts("x12_urls", lambda c: F.size(entities.urls(c)), r"len(regexp_extract_all(text, 'https?://[^\s\)\]\}<>\x22'']+'))::INT")
texts("x07_ifsc", lambda c: F.array_join(entities.distinct(c, entities.IFSC), " "), r"coalesce(array_to_string(list_distinct(regexp_extract_all(text, '\b[A-Z]{4}0[A-Z0-9]{6}\b')), ' '), '')")
texts("x07_accounts", lambda c: F.array_join(F.array_sort(entities.distinct(c, entities.ACCOUNT)), " "), r"coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]{9,18}\b'))), ' '), '')")
query("x02_dividend", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 3 = 2 THEN (o_orderkey % 50) * 10.0 / 100 ELSE (o_orderkey % 50)::DOUBLE END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", entities.dividend(F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("Rs. "), (C("o_orderkey") % 50).cast("string"), F.lit(" per equity share"))).when(C("o_orderkey") % 3 == 1, F.concat(F.lit("final dividend of Rs "), (C("o_orderkey") % 50).cast("string"))).otherwise(F.concat(F.lit("dividend of "), (C("o_orderkey") % 50).cast("string"), F.lit("% on face value of Rs 10")))).alias("out")))
query("x03_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.try_element_at(entities.dates(F.concat(F.lit("held on "), F.when(C("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy")), F.lit(" at noon"))), F.lit(1)).cast("string").alias("out")))
query("x04_date_near", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", entities.date_near(F.concat(F.lit("from 1999-01-01. The record date is "), F.date_format("o_orderdate", "yyyy-MM-dd")), "record date").cast("string").alias("out")))
query("x05_voting_window", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS a, (CAST(o_orderdate AS DATE) + 3)::VARCHAR AS b FROM orders")(
    lambda t: t("orders").select("o_orderkey", entities.voting_window(F.concat(F.lit("remote e-voting ends "), F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd"), F.lit(" and starts "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("w")).select("o_orderkey", C("w.start").cast("string").alias("a"), C("w.end").cast("string").alias("b")))
texts("x06_document_type", entities.document_type, "CASE WHEN contains(lower(text), 'dividend') THEN 'DIVIDEND' WHEN contains(lower(text), 'annual general meeting') OR contains(lower(text), 'agm') THEN 'AGM' WHEN contains(lower(text), 'e-voting') THEN 'EVOTING' WHEN contains(lower(text), 'result') THEN 'RESULTS' ELSE 'OTHER' END")
query("x08_trim_handle", "SELECT p_partkey, CASE WHEN length(p_name) + 21 > 24 THEN regexp_extract(p_name, '[a-zA-Z0-9]+$') ELSE 'pay to this account: ' || p_name END || '@bank' AS out FROM part")(
    lambda t: t("part").select("p_partkey", entities.trim_handle(F.concat(F.lit("pay to this account: "), "p_name", F.lit("@bank"))).alias("out")))
query("x15_amount", "SELECT o_orderkey, (o_orderkey % 100) * CASE o_orderkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e5 ELSE 1e7 END AS out FROM orders")(
    lambda t: t("orders").select("o_orderkey", F.try_element_at(entities.amounts(F.concat(F.lit("send Rs "), (C("o_orderkey") % 100).cast("string"), F.when(C("o_orderkey") % 3 == 0, " k").when(C("o_orderkey") % 3 == 1, " lakh").otherwise(" crore"))), F.lit(1)).alias("out")))
query("x16_registrations", "SELECT c_custkey, 'INZ' || lpad((c_custkey)::VARCHAR, 9, '0') AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", F.try_element_at(entities.registrations(F.concat(F.lit("reg no INZ"), F.lpad(C("c_custkey").cast("string"), 9, "0"), F.lit(" or inz12"))), F.lit(1)).alias("out")))
query("x18_payment_targets", "SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END)::INT AS n FROM customer")(
    lambda t: t("customer").select("c_custkey", F.size(entities.payment_targets(F.concat(F.lit("pay some.one@okbank"), F.when(C("c_custkey") % 2 == 0, " or ABCD0123456 account 123456789012").otherwise(" today")))).alias("n")))
query("x22_return_promises", "SELECT c_custkey, round((c_custkey % 40)::DOUBLE / CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 12.0 ELSE 7 / 30 END, 6) AS monthly FROM customer")(
    lambda t: t("customer").select("c_custkey", F.round(F.try_element_at(entities.return_promises(F.concat(F.lit("earn "), (C("c_custkey") % 40).cast("string"), F.lit("% per "), F.when(C("c_custkey") % 3 == 0, "month").when(C("c_custkey") % 3 == 1, "year").otherwise("week"))), F.lit(1))["monthly"], 6).alias("monthly")))
texts("x19_figures", lambda c: F.size(entities.claims(c)["figures"]), r"least(5, len(regexp_extract_all(text, '.{0,40}[0-9]+(?:\.[0-9]+)?\s?%.{0,40}')))::INT")
texts("x21_entity_kind", entities.entity_kind, r"CASE WHEN regexp_matches(lower(text), '\b(bank)\b') THEN 'BANK' WHEN regexp_matches(lower(text), '\b(broker|securities)\b') THEN 'BROKER' WHEN regexp_matches(lower(text), '\b(fund|amc)\b') THEN 'FUND' ELSE 'COMPANY' END")

query("v01_valid_cin", "SELECT c_custkey, c_custkey % 2 = 0 AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", checks.valid_cin(F.concat(F.lit("L"), F.lpad((C("c_custkey") % 100000).cast("string"), 5, "0"), F.when(C("c_custkey") % 2 == 0, "MH").otherwise("9H"), F.lit("2001PLC123456"))).alias("out")))
query("v02_isin", """WITH b AS (SELECT c_custkey, 'INE' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || '01' AS s FROM customer),
d AS (SELECT c_custkey, s, list_reverse(string_split(array_to_string(list_transform(string_split(s, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN (ascii(x) - 55)::VARCHAR ELSE x END), ''), '')) AS g FROM b),
u AS (SELECT c_custkey, s, unnest(g)::INT AS x, generate_subscripts(g, 1) AS i FROM d)
SELECT c_custkey, ((10 - sum(CASE WHEN i % 2 = 1 THEN CASE WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END ELSE x END) % 10) % 10)::INT AS digit FROM u GROUP BY c_custkey""")(
    lambda t: t("customer").select("c_custkey", checks.isin_digit(F.concat(F.lit("INE"), F.lpad((C("c_custkey") % 1000000).cast("string"), 6, "0"), F.lit("01"))).cast("int").alias("digit")))
query("v03_valid_isin", "SELECT r_regionkey, r_regionkey < 3 AS out FROM region")(
    lambda t: t("region").select("r_regionkey", checks.valid_isin(F.element_at(F.array(F.lit("INE009A01021"), F.lit("INE002A01018"), F.lit("US0378331005"), F.lit("INE009A01022"), F.lit("INE0")), C("r_regionkey") + 1)).alias("out")))
query("v04_gstin_pan", "SELECT c_custkey, c_custkey % 50 BETWEEN 1 AND 38 AS gstin, c_custkey % 2 = 0 AS pan FROM customer")(
    lambda t: t("customer").select("c_custkey", checks.valid_gstin(F.concat(F.lpad((C("c_custkey") % 50).cast("string"), 2, "0"), F.lit("ABCPE1234F1Z5"))).alias("gstin"), checks.valid_pan(F.concat(F.lit("ABC"), F.when(C("c_custkey") % 2 == 0, "P").otherwise("X"), F.lit("E1234F"))).alias("pan")))
query("v05_ifsc", "SELECT c_custkey, c_custkey % 3 = 0 AS out FROM customer")(
    lambda t: t("customer").select("c_custkey", checks.valid_ifsc(F.concat(F.lit("ZENB"), (C("c_custkey") % 3).cast("string"), F.lit("ABC123"))).alias("out")))
query("v06_registration_kind", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'BROKER' WHEN 1 THEN 'ADVISER' WHEN 2 THEN 'ANALYST' ELSE 'OTHER' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'INZ' WHEN 1 THEN 'INA' WHEN 2 THEN 'INH' ELSE 'INX' END AS prefix FROM customer")(
    lambda t: t("customer").select("c_custkey", F.concat(F.element_at(F.array(*map(F.lit, ("inz", "ina", "inh", "inx"))), (C("c_custkey") % 4 + 1).cast("int")), F.lit("000123")).alias("r")).select("c_custkey", checks.registration_kind(C("r")).alias("kind"), checks.prefix(C("r")).alias("prefix")))
query("v08_family", "SELECT 'INZ' AS prefix, 'D' AS kinds, min(3 + length(c_custkey::VARCHAR))::INT AS least, max(3 + length(c_custkey::VARCHAR))::INT AS most, count(*) AS members FROM customer")(
    lambda t: checks.family(t("customer").select(F.concat(F.lit("INZ"), C("c_custkey").cast("string")).alias("r")), "r"))
query("v10_uncovered", "SELECT r FROM (SELECT 'INZ' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN 'X' || c_nationkey ELSE '' END AS r, c_custkey FROM customer) WHERE c_custkey % 7 = 0")(
    lambda t: (lambda d: checks.uncovered(d, "r", checks.family_pattern(d.filter("c_custkey % 7 <> 0"), "r")).select("r"))(t("customer").select("c_custkey", F.concat(F.lit("INZ"), C("c_custkey").cast("string"), F.when(C("c_custkey") % 7 == 0, F.concat(F.lit("X"), C("c_nationkey").cast("string"))).otherwise("")).alias("r"))))
query("v12_generic_name", "SELECT p_partkey, p_partkey % 2 = 0 AS out FROM part")(
    lambda t: t("part").select("p_partkey", checks.generic_name(F.when(C("p_partkey") % 2 == 0, F.lit("The Bank of India")).otherwise(C("p_name"))).alias("out")))
query("v13_inconsistent", "SELECT l.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.n_chars % 6 >= 2")(
    lambda t: t("documents").join(t("labels"), "doc_id").filter(checks.inconsistent(F.when(C("quality") == 0, True), C("n_chars") % 6)).select("doc_id"))
query("v14_hamming", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, (SELECT sum(bit_count(xor(('0x' || substr(sha256(a.n_name), k * 8 + 1, 8))::BIGINT, ('0x' || substr(sha256(b.n_name), k * 8 + 1, 8))::BIGINT))) FROM range(8) r(k))::INT AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda t: t("nation").alias("x").join(t("nation").alias("y"), (C("x.n_regionkey") == C("y.n_regionkey")) & (C("x.n_nationkey") < C("y.n_nationkey"))).select(C("x.n_nationkey").alias("a"), C("y.n_nationkey").alias("b"), checks.hamming(F.sha2("x.n_name", 256), F.sha2("y.n_name", 256)).alias("d")))
