"""Queries of operators that keep state, indexes, versions or graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom.functions import urls
from veriloom.operators import collisions, coordination, decisions, features, provenance, retrieval, versions
from veriloom.plans.base import query
from veriloom.sources.shared import land, shared_dir
from veriloom.streaming import cache, flows, sweep

C = F.col

# --- coordinated posting: every document is a post of one of its source's accounts



def _base():
    return F.when(C("text").contains("$$$"), 0.9).otherwise(0.2)


def _items(docs):
    id_ = F.shiftleft(F.lit(200_000_000_000).cast("long") + C("doc_id") * 90_000, 22)
    return docs.withColumn("url", F.concat(F.lit("https://x.com/"), F.coalesce("source", F.lit("none")), F.lit("_"), (C("doc_id") % 50).cast("string"), F.lit("/status/"), id_.cast("string")))


_POSTS = r"""w AS (SELECT doc_id, coalesce(source, 'none') || '_' || doc_id % 50 AS handle, 1288834974657 + 200000000000 + doc_id * 90000 AS ms, contains(text, '$$$') AS odd,
  list_sort(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1)) AS words FROM documents),
p AS (SELECT *, sha256(array_to_string(words, ' ')) AS content FROM w WHERE len(words) > 0),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS token FROM p) GROUP BY 1),
tf AS (SELECT content, token, count(*) AS tf FROM (SELECT content, unnest(words) AS token FROM (SELECT content, any_value(words) AS words FROM p GROUP BY 1)) GROUP BY ALL),
r AS (SELECT content, token, tf * (ln((1 + (SELECT count(*) FROM p)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)),
n AS (SELECT content, token, w / sqrt(sum(w * w) OVER (PARTITION BY content)) AS w FROM r),
e AS (SELECT a.content AS a, b.content AS b FROM n a JOIN n b ON a.token = b.token AND a.content <> b.content GROUP BY ALL HAVING sum(a.w * b.w) >= 0.85),
g AS (SELECT DISTINCT content, content AS other FROM p UNION SELECT g.content, e.b FROM g JOIN e ON e.a = g.other),
k AS (SELECT content, min(other) AS cluster FROM g GROUP BY 1),
c AS (SELECT cluster, min(doc_id) AS first_id, count(*) AS posts, count(DISTINCT handle) AS accounts, max(ms) - min(ms) AS span FROM p JOIN k USING (content) GROUP BY 1),
s AS (SELECT *, CASE WHEN accounts >= 3 THEN round(least(1.0, 0.5 * least(1.0, (accounts - 2) / 12.0) + 0.5 * CASE WHEN span / 6e4 <= 60 THEN 1.0 ELSE greatest(0.0, 1 - (span / 6e4 - 60) / 1440) END), 4) END AS score FROM c)"""


def _named(rows):
    """Clusters by the least document of theirs."""
    return rows.groupBy("cluster").agg(F.min("post").alias("first_id"))


def _batch(t):
    return coordination.posts(_items(t("documents")), "doc_id", "url", "text")


def _m03(t):
    found = coordination.analyse(_batch(t))
    clusters = coordination.summed(coordination.seen(found, "cluster"))
    span = (F.unix_millis("last") - F.unix_millis("first")).alias("span")
    return clusters.join(_named(found), "cluster").filter("score is not null").select("first_id", "posts", "accounts", span, "score")


query("m03_coordination", f"WITH RECURSIVE {_POSTS} SELECT first_id, posts, accounts, span, score FROM s WHERE score IS NOT NULL")(_m03)
query("m03_signal", f"WITH RECURSIVE {_POSTS}, top AS (SELECT accounts, span FROM s WHERE score IS NOT NULL ORDER BY score DESC, accounts DESC, cluster DESC LIMIT 1) SELECT coalesce(max(score), 0.0) AS score, (SELECT count(*) FROM p) >= 3 AS available, count(score) AS n_clusters, (SELECT count(*) FROM p) AS posts_analysed, CASE WHEN (SELECT count(*) FROM p) < 3 THEN format('only {{}} post(s) with an account and a time: too few to tell', (SELECT count(*) FROM p)) WHEN count(score) = 0 THEN format('no coordinated clusters in {{}} posts', (SELECT count(*) FROM p)) ELSE format('{{}} accounts posted nearly the same within {{}} minutes', (SELECT accounts FROM top), (SELECT round(span / 6e4)::BIGINT FROM top)) END AS summary FROM s")(
    lambda t: (lambda found: coordination.signal(coordination.summed(coordination.seen(found, "cluster")), found))(coordination.analyse(_batch(t))))


def _p11(t):
    """The same clusters and verdicts, from documents that come in four batches."""
    path = land(_items(t("documents")).repartition(4, "doc_id"), "parquet")
    kept = coordination.Campaigns(t.spark, f"{shared_dir(t.spark)}/campaigns-{uuid.uuid4().hex}", coordination.idf(_batch(t)))
    stream = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    coordination.run(stream, kept, _base(), "doc_id", "url", "text")
    rows = kept.verdicts().join(kept.clusters().select("cluster", "accounts", "posts"), "cluster")
    names = _named(rows)
    return rows.join(names, "cluster").select(C("post").alias("doc_id"), "first_id", "posts", "accounts", "signal", "score", "band")


query("p11_recluster", f"WITH RECURSIVE {_POSTS}, v AS (SELECT doc_id, first_id, posts, accounts, coalesce(score, 0.0) AS signal, round((0.25 * CASE WHEN odd THEN 0.9 ELSE 0.2 END + 0.1 * coalesce(score, 0.0)) / 0.35, 4) AS score FROM p JOIN k USING (content) JOIN s USING (cluster)) SELECT *, CASE WHEN score >= 0.8 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' ELSE 'Low' END AS band FROM v")(_p11)


# --- ranking of documents for passages

query("m05_lexical_rank", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1)) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY 1), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1)) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + ((SELECT count(*) FROM l) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM l)))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN l USING (doc_id) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS place FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")(
    lambda t: retrieval.rank(retrieval.build(t("documents"), "doc_id", "text"), t("benchmark"), "item_id", "text", 10).select(C("query").alias("item_id"), C("id").alias("doc_id"), "score", "place"))


# --- cached look-ups


def _p05(t):
    """Look-ups by user that come in four files, each out of order within itself; entries last six hours."""
    rows = t("events").select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    path = f"{shared_dir(t.spark)}/lookups-{uuid.uuid4().hex}"
    for k in range(4):
        part = F.least(F.lit(3), F.floor(4 * (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)))
        rows.filter(part == k).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with cache.state_store(t.spark, t.spark.sparkContext.defaultParallelism):
        return flows.run_to_table(cache.cached(stream, "user_id", "event_id", "ts", 6 * 3600))


query("p05_ttl_cache", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, us, k, 'miss' AS outcome, us AS stored FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.k, CASE WHEN e.us - stored < 21600000000 THEN 'hit' ELSE 'miss' END, CASE WHEN e.us - stored < 21600000000 THEN stored ELSE e.us END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
x AS (SELECT user_id, event_id, us, outcome, stored FROM r UNION ALL SELECT user_id, NULL, stored + 21600000000, 'expiry', stored FROM r WHERE outcome = 'miss')
SELECT user_id::VARCHAR AS key, event_id AS id, us AS "at", outcome, stored FROM x WHERE us < (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)""")(_p05)


# --- sweep of landed records: orders by priority are the sources, some of their lines are damaged

_LINE = """'{"key":' || o_orderkey || ',"mark":' || o_orderkey || ',"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || '}'"""
_DAMAGED = f"""CASE WHEN o_orderkey % 97 = 5 THEN left({_LINE}, length({_LINE}) - 4) WHEN o_orderkey % 97 = 6 THEN replace({_LINE}, '"key"', '"id"') WHEN o_orderkey % 97 = 7 THEN replace({_LINE}, '"mark":', '"mark":null,"was":') WHEN o_orderkey % 97 = 8 THEN '[' || {_LINE} || ']' ELSE {_LINE} END"""


def _p10(t):
    """Half of the orders land and are swept, then all of them land again beside these and are swept, twice."""
    top = f"{shared_dir(t.spark)}/sweep-{uuid.uuid4().hex}"
    rows = t("orders").select("o_orderkey", F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "")).alias("source"), F.expr(_DAMAGED).alias("line"))
    names = ["urgent", "high", "medium", "notspecified", "low", "silent"]
    middle = rows.agg(F.max("o_orderkey")).first()[0] // 2
    for part in (rows.filter(C("o_orderkey") <= middle), rows, rows.filter("o_orderkey % 3 = 0")):
        for name in names[:-1]:
            part.filter(C("source") == name).select("line").write.mode("append").text(f"{top}/in/{name}")
        sweep.sweep(t.spark, {name: f"{top}/in/{name}" for name in names}, f"{top}/store", "key", "mark")
    taken = sweep.stored(t.spark, f"{top}/store", "rows").select("source", F.lit(None).cast("string").alias("cause"), "key", C("body").alias("line"))
    return taken.unionByName(sweep.stored(t.spark, f"{top}/store", "bad").select("source", "cause", F.lit(None).cast("string").alias("key"), "line"))


query("p10_sweep", f"""WITH r AS (SELECT o_orderkey AS k, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g')) AS source, {_DAMAGED} AS line FROM orders)
SELECT source, CASE k % 97 WHEN 5 THEN 'not_json' WHEN 6 THEN 'no_key' WHEN 7 THEN 'no_mark' WHEN 8 THEN 'not_json' END AS cause, CASE WHEN k % 97 NOT BETWEEN 5 AND 8 THEN k::VARCHAR END AS key, line FROM r""")(_p10)

# --- versions of a register: customers, and the same after changes in a few ranges of keys



def _range():
    return F.floor(C("c_custkey") / 64)


def _z65(t):
    folder = f"{shared_dir(t.spark)}/register-{uuid.uuid4().hex}"
    old = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    versions.snapshot(old, "c_custkey", _range(), folder, 1)
    near = C("c_custkey") % 1000 < 40
    new = old.filter(~(near & (C("c_custkey") % 10 == 0))).withColumn("c_acctbal", F.when(near & (C("c_custkey") % 10 == 1), C("c_acctbal") + 1).otherwise(C("c_acctbal")))
    new = new.unionByName(old.filter("c_custkey % 500 = 3").withColumn("c_custkey", C("c_custkey") + 1_000_000))
    versions.snapshot(new, "c_custkey", _range(), folder, 2)
    rows = versions.differences(t.spark, folder, 1, 2)
    return rows.select("key", "change", C("was.c_acctbal").alias("was"), C("now.c_acctbal").alias("now"))


query("z65_snapshot_diff", """SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change, c_acctbal AS was, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 1 END AS now FROM customer WHERE c_custkey % 1000 < 40 AND c_custkey % 10 < 2
UNION ALL SELECT c_custkey + 1000000, 'added', NULL, c_acctbal FROM customer WHERE c_custkey % 500 = 3""")(_z65)


def _harvests(t):
    """Rows of two harvests of a register: the second repeats a third of the first, under another category for some."""
    number = F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), F.lpad(C("c_custkey").cast("string"), 9, "0"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (C("c_nationkey") % 20).cast("int"))
    rows = t("customer").select(number.alias("number"), C("c_mktsegment").alias("category"), F.lit(1).alias("landed"), C("c_name").alias("name"), day.alias("as_on"))
    return rows.unionByName(rows.filter("substr(number, 11, 1) in ('0', '3', '6')").withColumn("landed", F.lit(2)).withColumn("category", F.when(C("number").endswith("6"), "OTHER").otherwise(C("category"))).withColumn("as_on", F.date_add("as_on", 30)))


_HARVESTS = "b AS (SELECT upper(left(c_mktsegment, 2)) || lpad(c_custkey::VARCHAR, 9, '0') AS number, c_mktsegment AS category, 1 AS landed, c_name AS name, DATE '2024-01-01' + (c_nationkey % 20)::INT AS as_on FROM customer), h AS (SELECT * FROM b UNION ALL SELECT number, CASE WHEN number LIKE '%6' THEN 'OTHER' ELSE category END, 2, name, as_on + 30 FROM b WHERE right(number, 1) IN ('0', '3', '6')), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY number ORDER BY landed, category) = 1)"
query("z65_register", f"WITH {_HARVESTS} SELECT number, category, name, strftime(as_on, '%Y-%m-%d') AS as_on FROM m")(
    lambda t: versions.merged(_harvests(t)).withColumn("as_on", C("as_on").cast("string")))
query("z22_coverage", f"WITH {_HARVESTS}, d AS (SELECT category, max(as_on) AS as_on, count(*) AS harvested FROM h GROUP BY 1), p AS (SELECT regexp_extract(upper(number), '^[A-Z]+') AS prefix, arg_min(category, number) AS category, count(*) AS records FROM m GROUP BY 1) SELECT prefix, category, strftime(as_on, '%Y-%m-%d') AS as_on, harvested, records FROM p JOIN d USING (category)")(
    lambda t: versions.coverage(versions.merged(_harvests(t)), _harvests(t)).withColumn("as_on", C("as_on").cast("string")))


def _z22(t):
    """Every order claims that its customer stood in the register of their segment on its date; a segment's register is
    renewed in two years of three, and covers the segment in every other."""
    claims = t("orders").join(t("customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("category")), "o_custkey").select("o_orderkey", C("o_custkey").alias("number"), "category", C("o_orderdate").cast("date").alias("day"))
    years = t("orders").select(F.year("o_orderdate").alias("y")).distinct().crossJoin(t("customer").select(C("c_mktsegment").alias("category")).distinct())  # years and segments, a few rows each
    kept = years.withColumn("k", C("y") + F.length("category")).filter("k % 3 <> 0").select("category", F.make_date("y", F.lit(1) + C("k") % 5, F.lit(15)).alias("since"), (C("k") % 2 == 0).alias("covered"))
    register = t("customer").join(kept.withColumnRenamed("category", "c_mktsegment"), "c_mktsegment").filter((C("c_custkey") + F.year("since")) % 7 != 0).select(C("c_custkey").alias("number"), "since")
    rows = versions.standing(versions.as_of(claims, kept, "category", "day"), register)
    return rows.select("o_orderkey", "number", C("since").cast("string").alias("since"), "covered", "state")


query("z22_as_of_coverage", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, c_mktsegment AS category FROM orders, (SELECT DISTINCT c_mktsegment FROM customer)),
v AS (SELECT category, make_date(y, 1 + (y + length(category)) % 5, 15) AS since, (y + length(category)) % 2 = 0 AS covered FROM y WHERE (y + length(category)) % 3 <> 0),
c AS (SELECT o_orderkey, c_custkey AS number, c_mktsegment AS category, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT c.*, v.since, v.covered FROM c ASOF LEFT JOIN v ON c.category = v.category AND c.day >= v.since)
SELECT o_orderkey, number, strftime(since, '%Y-%m-%d') AS since, covered, CASE WHEN since IS NOT NULL AND (number + year(since)) % 7 <> 0 THEN 'valid' WHEN covered THEN 'invalid' ELSE 'unverified' END AS state FROM a""")(_z22)

# --- features of URLs and pages

_H = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g'))"
_ENTROPY = "coalesce((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({0}) AS p FROM (SELECT unnest(string_split({0}, '')) AS ch) GROUP BY ch)), 0.0)"


def _n(text: str, part: str) -> str:
    return f"(length({text}) - length(replace({text}, '{part}', ''))) / {len(part)}"


def _attr(tag: str, name: str) -> str:
    p = rf"(?is)[\s\"'']{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))"
    return "trim(" + " || ".join(f"regexp_extract({tag}, '{p}', {i})" for i in (1, 2, 3)) + ")"


def _outside(u: str) -> str:
    h = rf"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)', 1))"
    return f"(regexp_matches({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AND {h} <> '' AND NOT contains({h}, host) AND NOT contains(host, {h}))"


def _starts(*names: str) -> str:
    return "list_filter(tags, lambda t: NOT starts_with(t, '</') AND lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) IN (" + ", ".join(f"'{n}'" for n in names) + "))"


_EITHER = f"(CASE WHEN {_attr('t', 'src')} <> '' THEN {_attr('t', 'src')} ELSE {_attr('t', 'href')} END)"
_LOADED = f"list_filter({_starts('img', 'link', 'source')}, lambda t: {_EITHER} <> '')"
_EMPTY = f"{_attr('t', 'href')} IN ('', '#', 'javascript:void(0)')"
_VOIDS = ", ".join(f"'{n}'" for n in features.VOID)
_MOVES = f"flatten(list_transform(tags, lambda t: CASE WHEN lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) IN ({_VOIDS}) THEN []::INT[] WHEN starts_with(t, '</') THEN [-1] WHEN ends_with(t, '/>') THEN [1, -1] ELSE [1] END))"
_RUNS = "len(list_filter(range(1, length(reg) + 1), lambda i: i > 2 AND reg[i] = reg[i - 1] AND reg[i] = reg[i - 2] AND (i = 3 OR reg[i - 3] <> reg[i])))"
_FEATURES = {
    "url_length": "length(url)", "url_entropy": f"round({_ENTROPY.format('url')}, 4)", "subdomain_count": f"greatest({_n('host', '.')} - 1, 0)", "param_count": _n(r"regexp_extract(url, '\?([^#]*)', 1)", "="),
    "has_ip_host": r"regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$')::INT", "has_punycode": "contains(host, 'xn--')::INT", "sensitive_keyword_count": " + ".join(f"(contains(lower(url), '{k}') OR contains(lower(body), '{k}'))::INT" for k in features.SENSITIVE),
    "external_link_ratio": f"round(len(list_filter({_starts('a')}, lambda t: NOT {_EMPTY} AND {_outside(_attr('t', 'href'))})) / greatest(len({_starts('a')}), 1), 4)", "empty_links_ratio": f"round(len(list_filter({_starts('a')}, lambda t: {_EMPTY})) / greatest(len({_starts('a')}), 1), 4)",
    "suspicious_form_action": f"(len(list_filter({_starts('form')}, lambda t: {_attr('t', 'action')} <> '' AND {_outside(_attr('t', 'action'))})) > 0)::INT",
    "hidden_iframe_count": rf"len(list_filter({_starts('iframe')}, lambda t: regexp_matches(t, '(?i)\shidden(?:[\s=/>]|$)') OR contains(lower({_attr('t', 'style')}), 'display:none') OR {_attr('t', 'width')} IN ('0', '1')))",
    "script_to_content_ratio": f"round(len({_starts('script')}) / greatest(chars // 40, 1), 4)", "password_field_count": f"len(list_filter({_starts('input')}, lambda t: lower({_attr('t', 'type')}) = 'password'))", "input_field_count": f"len({_starts('input')})",
    "meta_refresh_present": f"(len(list_filter({_starts('meta')}, lambda t: lower({_attr('t', 'http-equiv')}) = 'refresh')) > 0)::INT", "external_resource_ratio": f"round(len(list_filter({_LOADED}, lambda t: {_outside(_EITHER)})) / greatest(len({_LOADED}), 1), 4)",
    "dom_nesting_depth": f"list_reduce(list_prepend(0::BIGINT, {_MOVES}), lambda s, m: greatest(s // 100000, s % 100000 + m) * 100000 + greatest(s % 100000 + m, 0)) // 100000",
    "upi_id_present": "(len(handles) > 0)::INT", "upi_outside_valid_namespace": "(len(handles) > 0 AND len(list_filter(handles, lambda u: contains(lower(u), '@valid'))) = 0)::INT", "registration_claim_present": f"regexp_matches(body, '{features.CLAIM}')::INT", "registration_resolves": "0",
    "securities_keyword_density": "round((" + " + ".join(_n("low", k) for k in features.SECURITIES) + ") / greatest(len(regexp_extract_all(low, '[a-z0-9]+')), 1), 4)", "typosquat_distance_to_intermediary": "99", "guaranteed_return_claim_present": f"regexp_matches(low, '{features.PROMISE}')::INT",
    "host_len": "length(reg)", "host_entropy": _ENTROPY.format("reg"), "label_count": "len(labels)", "hyphens": _n("reg", "-"), "digits": "length(regexp_replace(reg, '[^0-9]', '', 'g'))", "digit_ratio": "coalesce(length(regexp_replace(reg, '[^0-9]', '', 'g')) / nullif(length(reg), 0), 0)",
    "vowel_ratio": "coalesce(length(regexp_replace(reg, '[^aeiou]', '', 'g')) / nullif(length(regexp_replace(reg, '[^A-Za-z]', '', 'g')), 0), 0)", "longest_label": "coalesce(list_max(list_transform(labels, lambda x: length(x))), 0)", "tld_len": "length(labels[-1])",
    "suspicious_tld": "(labels[-1] IN (" + ", ".join(f"'{k}'" for k in features.POOR_TLDS) + "))::INT", "has_ip": "0", "brand_token_count": " + ".join(f"contains(reg, '{b}')::INT" for b in features.BRANDS), "domain_entropy": _ENTROPY.format("label"), "domain_len": "length(label)",
    "repeated_char_runs": _RUNS, "consonant_run_max": "coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0)", "has_digit_letter_mix": "(regexp_matches(label, '[0-9]') AND regexp_matches(label, '[A-Za-z]'))::INT",
}
_PAGES = rf"""a AS (SELECT page_id, url, html, {_H} AS host, {_TEXT} AS body, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<!>', 'g'), '(?is)(<script\b[^>]*>).*?(</script\s*>)', '\1\2', 'g'), '(?is)(<style\b[^>]*>).*?(</style\s*>)', '\1\2', 'g') AS bare FROM pages),
b AS (SELECT *, regexp_extract_all(bare, '(?s)</?[A-Za-z][^>]*>') AS tags, lower(url || chr(10) || body) AS low, regexp_replace(host, '^www\.', '') AS reg, list_concat(regexp_extract_all(body, '{features.HANDLE}'), regexp_extract_all(url, '{features.HANDLE}')) AS handles,
  list_sum(list_transform(list_concat(regexp_split_to_array(bare, '(?s)<!--.*?-->|<![^>]*>|</?[A-Za-z][^>]*>'), regexp_extract_all(html, '(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)\s*>', 1)), lambda p: length(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '&(?:#[0-9]+|[A-Za-z]+);', '.', 'g')))) AS chars FROM a),
c AS (SELECT *, string_split(reg, '.') AS labels, list_extract(string_split(reg, '.'), -2) AS label FROM b)"""
query("m09_features", f"WITH {_PAGES} SELECT page_id, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _FEATURES.items()) + " FROM c")(lambda t: features.extract(t("pages")).select("page_id", *_FEATURES))

_PATH, _QUERY = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1)", r"regexp_extract(url, '\?([^#]*)', 1)"
_LETTERS = r"length(regexp_replace(url, '[^\p{L}]', '', 'g'))"
_ARTEFACTS = {
    "url_len": "length(url)", "host_len": f"length({_H})", "path_len": f"length({_PATH})", "query_len": f"length({_QUERY})", "n_dots": _n("url", "."), "n_slashes": _n("url", "/"), "n_hyphens": _n("url", "-"), "n_digits": "length(regexp_replace(url, '[^0-9]', '', 'g'))", "digit_ratio": "length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url)",
    "n_params": _n(_QUERY, "="), "n_amps": _n(_QUERY, "&"), "is_https": "starts_with(url, 'https:')::INT", "has_www": f"starts_with({_H}, 'www.')::INT", "has_port": r"regexp_matches(url, '^[a-z]+://[^/?#]*:[0-9]')::INT", "n_subdomains": f"greatest(len(string_split({_H}, '.')) - 2, 0)", "tld_len": f"length(list_extract(string_split({_H}, '.'), -1))",
    "url_entropy": _ENTROPY.format("url"), "host_entropy": _ENTROPY.format("host"), "path_depth": f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))", "has_query": f"({_QUERY} <> '')::INT", "has_fragment": "(contains(url, '#') AND NOT ends_with(url, '#'))::INT", "n_upper": r"length(regexp_replace(url, '[^\p{Lu}]', '', 'g'))",
    "n_special": r"length(regexp_replace(url, '[\p{L}\p{N}]', '', 'g'))", "longest_token": "list_max(list_transform(regexp_extract_all(url, '[A-Za-z0-9]+'), lambda x: length(x)))", "has_ip": rf"regexp_matches({_H}, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$')::INT", "has_punycode": f"contains({_H}, 'xn--')::INT", "n_at": _n("url", "@"), "n_equals": _n("url", "="),
    "n_underscore": _n("url", "_"), "n_percent": _n("url", "%"), "path_has_ext": rf"regexp_matches({_PATH}, '(?i)\.(php|html?|aspx?|jsp)$')::INT", "n_letters": _LETTERS, "vowel_ratio": f"length(regexp_replace(url, '[^aeiouAEIOU]', '', 'g')) / {_LETTERS}", "bare_homepage": f"(trim({_PATH}, '/') = '')::INT",
}
query("m10_artefacts", f"WITH p AS (SELECT page_id, url, {_H} AS host FROM pages) SELECT page_id, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _ARTEFACTS.items()) + " FROM p")(lambda t: features.with_artefacts(t("pages")).select("page_id", *_ARTEFACTS))

# --- out-of-fold models of labelled documents, by source


def _labelled(t):
    symbols = {"symbols": "[#$%&*]", "bars": r" \| ", "repeats": "!!", "lines": "\n"}
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", "source", "lang", (1 - C("quality")).cast("double").alias("y"), C("n_chars").cast("double").alias("n_chars"), *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("double").alias(k) for k, p in symbols.items()])
    return features.out_of_fold(d, ["n_chars", *symbols], "y", F.concat_ws("/", "source", "lang"))


query("z60_out_of_fold")(lambda t: _labelled(t).select("doc_id", "fold", "y", F.round("p", 6).alias("p")))
query("z60_measures")(lambda t: features.pooled(_labelled(t), "y"))

# --- verdicts on the URLs of pages

_TRUSTED = f"({_H} = 'example.org' OR {_H} LIKE '%.example.org' OR {_H} = 'exchange.example.com' OR {_H} LIKE '%.exchange.example.com')"
_SCORE = f"greatest(0, least(100, 60 + CASE WHEN {_TRUSTED} THEN 30 ELSE 0 END + CASE WHEN starts_with(url, 'https://') THEN 5 ELSE -15 END + CASE WHEN {_H} LIKE '%.net' THEN -10 ELSE 0 END + CASE WHEN len(string_split({_H}, '.')) >= 5 THEN -20 WHEN len(string_split({_H}, '.')) >= 4 THEN -8 ELSE 0 END + CASE WHEN length({_H}) > 40 THEN -5 ELSE 0 END))"


def _domains(t):
    return t("pages").groupBy(urls.host(C("url")).alias("host")).agg((F.min("page_id") % 400).cast("int").alias("age_days"), F.bool_or(C("url").contains("adult")).alias("listed"))


query("z13_trust", f"""WITH d AS (SELECT {_H} AS host, min(page_id) % 400 AS age_days, bool_or(contains(url, 'adult')) AS listed FROM pages GROUP BY 1),
r AS (SELECT page_id, url, {_H} AS host, {_TRUSTED} AS trusted, {_SCORE} AS base FROM pages), s AS (SELECT r.*, NOT trusted AND listed AS bad, NOT trusted AND age_days < 30 AS young FROM r JOIN d USING (host)),
f AS (SELECT *, greatest(0, base - 40 * bad::INT - 15 * young::INT)::INT AS trust_score FROM s)
SELECT page_id, trust_score, CASE WHEN trust_score >= 75 THEN 'LOW' WHEN trust_score >= 50 THEN 'MODERATE' WHEN trust_score >= 25 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  array_to_string(list_filter([CASE WHEN bad THEN 'listed' END, CASE WHEN young THEN 'young' END, CASE WHEN starts_with(url, 'http://') THEN 'plain_http' END, CASE WHEN host LIKE '%.net' THEN 'tld_medium' END], lambda x: x IS NOT NULL), ',') AS signals,
  (CASE WHEN trust_score < 40 THEN 1 ELSE 0 END + CASE WHEN starts_with(url, 'http://') THEN 1 ELSE 0 END)::INT AS n_advice FROM f""")(
    lambda t: decisions.url_trust(t("pages").select("page_id", "url"), "url", _domains(t)).select("page_id", "trust_score", "risk_level", F.array_join("signals", ",").alias("signals"), F.size("advice").alias("n_advice")))

_LOCAL = "CASE WHEN {0} THEN 'safe' WHEN {1} LIKE '%.net' OR starts_with({2}, 'http:') THEN 'unverified' ELSE 'safe' END"
_FH = _H.replace("(url,", "(final,")
query("z06_preflight", f"""WITH p AS (SELECT page_id, url, {_H} AS host, {_TRUSTED} AS trusted, contains(url, 'ref=x') AS hides FROM pages), bad AS (SELECT DISTINCT host FROM p WHERE contains(host, 'adult')),
hops AS (SELECT a.url, min(b.url) AS final FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.page_id % 3 <> 0 GROUP BY 1),
j AS (SELECT p.*, h.final, {_LOCAL.format('trusted', 'host', 'p.url')} AS local, p.host IN (SELECT host FROM bad) AS blocked FROM p LEFT JOIN hops h ON h.url = p.url),
k AS (SELECT *, {_FH} AS fhost FROM j), l AS (SELECT *, CASE WHEN blocked AND NOT (trusted AND NOT hides) THEN 'dangerous' ELSE local END AS own, CASE WHEN final IS NULL THEN NULL WHEN fhost IN (SELECT host FROM bad) THEN 'dangerous' ELSE {_LOCAL.format(_TRUSTED.replace('(url,', '(final,'), 'fhost', 'final')} END AS there FROM k)
SELECT page_id, local, CASE WHEN hides AND list_position(['safe', 'unverified', 'suspicious', 'dangerous'], there) > list_position(['safe', 'unverified', 'suspicious', 'dangerous'], own) THEN there ELSE own END AS verdict,
  CASE WHEN hides THEN final END AS destination, CASE WHEN NOT hides AND trusted THEN 'settled' WHEN NOT hides THEN 'looked_up' WHEN final IS NULL THEN 'unknown' ELSE 'followed' END AS reason FROM l""")(
    lambda t: decisions.preflight_links(t("pages"), "page_id", "url", t("pages").select(urls.host(C("url")).alias("host")).filter(C("host").contains("adult")), t("pages").filter("page_id % 3 <> 0").join(t("pages").select((C("page_id") - 1).alias("page_id"), C("url").alias("final")), "page_id").select("url", "final"), C("url").contains("ref=x")))

# --- content credentials of pages, each made from the page before on its host and from one with a third of its number

_MANIFEST = """CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN url ELSE '{"active_manifest":"m","manifests":{"m":{"signature_info":{"issuer":"' || host || '"},"assertions":[{"label":"c2pa.actions","data":{"actions":[{"digitalSourceType":"' || CASE WHEN contains(html, '***') THEN 'http://types/trainedAlgorithmicMedia' ELSE 'http://types/camera' END || '"}]}}],"ingredients":[{"id":"a"},{"id":"b"}]}},"validation_status":[{"code":"' || CASE WHEN page_id % 61 = 5 THEN 'assertion.dataHash.mismatch' ELSE 'info.ok' END || '"}]}' END"""


def _states(t):
    return t("pages").withColumn("host", urls.host(C("url"))).withColumn("m", F.expr(_MANIFEST)).select("page_id", "host", provenance.interpret(C("m"), ("example.org",)).alias("p")).select("page_id", "host", "p.*")


_STATES = f"""h AS (SELECT page_id, url, html, {_H} AS host FROM pages), s AS (SELECT page_id, host, contains(html, '***') AS made, CASE WHEN page_id % 7 = 0 THEN 'no_credentials' WHEN page_id % 7 = 1 THEN 'unsupported' WHEN page_id % 61 = 5 THEN 'tampered' WHEN contains(host, 'example.org') THEN 'verified_signed' ELSE 'signed_untrusted' END AS state FROM h)"""
query("r18_provenance", f"""WITH {_STATES} SELECT page_id, state, CASE state WHEN 'tampered' THEN -35 WHEN 'verified_signed' THEN 20 ELSE 0 END AS delta, CASE WHEN state NOT IN ('no_credentials', 'unsupported') THEN host END AS signer,
CASE WHEN state NOT IN ('no_credentials', 'unsupported') THEN CASE WHEN made THEN 'trainedAlgorithmicMedia' ELSE 'http://types/camera' END END AS declared, CASE WHEN state IN ('no_credentials', 'unsupported') THEN 0 ELSE 2 END AS n_ingredients, CASE WHEN state = 'tampered' THEN 'assertion.dataHash.mismatch' ELSE '' END AS codes FROM s""")(
    lambda t: _states(t).select("page_id", "state", "delta", "signer", "declared", "n_ingredients", F.array_join("codes", ",").alias("codes")))


def _r18(t):
    s = _states(t)
    before = F.lag("page_id").over(Window.partitionBy("host").orderBy("page_id"))
    uses = s.select(C("page_id").alias("id"), before.alias("part")).filter("part is not null")
    uses = uses.unionByName(s.filter("page_id % 5 = 0 and page_id > 0").select(C("page_id").alias("id"), F.floor(C("page_id") / 3).alias("part")))
    return provenance.worst_source(s.select(C("page_id").alias("id"), "state"), uses).select(C("id").alias("page_id"), "worst", "source")


query("r18_worst_source", f"""WITH RECURSIVE {_STATES}, u AS (SELECT page_id AS id, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS part FROM s UNION ALL SELECT page_id, page_id // 3 FROM s WHERE page_id % 5 = 0 AND page_id > 0),
r AS (SELECT page_id AS id, page_id AS other FROM s UNION SELECT r.id, u.part FROM r JOIN u ON u.id = r.other WHERE u.part IS NOT NULL),
k AS (SELECT r.id, s.page_id AS source, s.state, list_position(['tampered', 'signed_untrusted', 'unsupported', 'no_credentials', 'verified_signed'], s.state) AS rank FROM r JOIN s ON s.page_id = r.other)
SELECT id AS page_id, state AS worst, source FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, source) = 1""")(_r18)

# --- recall of collisions that are put among the sightings that orders give


def _z52(t):
    """Twenty victims a segment get one to three false handles, some days apart; orders are sightings of their customer's
    number by their own handle, and by others where they are urgent."""
    owners = t("customer").select(C("c_custkey").alias("number"), F.concat(F.lit("own-"), C("c_custkey").cast("string")).alias("handle"))
    victims = collisions.draw(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 20)
    k = C("c_custkey")
    fake = collisions.injected(victims, "c_custkey", (1 + k % 3).cast("int"), F.lit("2001-01-01").cast("timestamp"), 10 + k % 40)
    urgent = C("o_orderpriority").startswith("1") & (C("o_orderkey") % 8 == 0)
    real = t("orders").select(C("o_custkey").alias("number"), F.when(urgent, F.concat(F.lit("other-"), (C("o_orderkey") % 5).cast("string"))).otherwise(F.concat(F.lit("own-"), C("o_custkey").cast("string"))).alias("handle"), C("o_orderdate").cast("timestamp").alias("ts"))
    found = collisions.detect(real.unionByName(fake), owners)
    return collisions.recall(t("customer"), victims, found, "c_custkey", "c_mktsegment")


query("z52_collision_recall", """WITH v AS (SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR), c_custkey) <= 20),
i AS (SELECT c_custkey AS number, unnest(range(1, 2 + c_custkey % 3)) AS i FROM v), x AS (
  SELECT number, 'fake-' || i AS handle, TIMESTAMP '2001-01-01' + to_days(((i - 1) * (10 + number % 40))::INT) AS ts FROM i
  UNION ALL SELECT o_custkey, 'other-' || o_orderkey % 5, o_orderdate FROM orders WHERE starts_with(o_orderpriority, '1') AND o_orderkey % 8 = 0),
f AS (SELECT DISTINCT a.number FROM x a JOIN x b ON a.number = b.number AND a.handle <> b.handle AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 2592000000000)
SELECT c.c_mktsegment, count(v.c_custkey) AS victims, count(*) FILTER (v.c_custkey IS NOT NULL AND f.number IS NOT NULL) AS detected, count(*) FILTER (v.c_custkey IS NULL AND f.number IS NOT NULL) AS false_alarms,
  round(count(*) FILTER (v.c_custkey IS NOT NULL AND f.number IS NOT NULL) / nullif(count(v.c_custkey), 0), 6) AS recall
FROM customer c LEFT JOIN v ON v.c_custkey = c.c_custkey LEFT JOIN f ON f.number = c.c_custkey GROUP BY 1""")(_z52)
