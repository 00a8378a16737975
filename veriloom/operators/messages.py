"""Messages as parsed inputs: routing by kind, requests for value, official contacts, reports, scripts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import markup, text, urls
from veriloom.operators.lookups import by_suffix, longest_name, names_in_text

# Advice that isn't a request, requests for money or credentials, words of chat names, feeds.
ADVICE = r"(?i)\b(?:do\s+not|don'?t|never|will\s+never|no\s+one\s+(?:can|will)|we\s+(?:do\s+not|never))\b[^.!?\n]{0,80}"
SOLICITS = (
    r"(?i)\b(?:pay|transfer|remit|deposit|send)\b[^.!?\n]{0,50}\b(?:rs\.?|inr|₹|amount|fee|charge|upi|account|a/c)\b"
    r"|\b(?:share|send|provide|confirm)\b[^.!?\n]{0,30}\b(?:otp|pin|cvv|password|mpin)\b|\bprocessing\s*fee\b|\bverification\s*(?:fee|charge)\b"
)
PREFIX = 20_000
SECURITIES_NAMES = ("stock", "share", "trading", "trader", "market", "nifty", "option", "invest", "equity", "ipo")
GENERIC_NAMES = ("vip", "premium", "official", "group", "club", "signals", "tips")
FEEDS = {"urlhaus_url": "listed", "urlhaus_host": "listed", "phishtank": "is_phish", "google_safe_browsing": "is_threat"}
UNSAFE = ("unsafe", "phishing", "malware")


def solicits_value(body: Column, pays: Column | None = None, most: int = PREFIX) -> Column:
    """Whether a message asks to pay or to hand over a credential: it names where to pay to (pays), or its first so many
    characters hold a request, once warnings against such requests are taken out."""
    said = F.regexp_replace(F.left(F.coalesce(body, F.lit("")), F.lit(most)), ADVICE, " ")
    found = said.rlike(SOLICITS)
    return found if pays is None else F.coalesce(pays, F.lit(False)) | found


def routed(inputs: DataFrame, key: str, data: str, name: str) -> DataFrame:
    """key, source_type, body, subject, sender, urls, content_hash and error of inputs (bytes and a file name).

    Mail is parsed, and only mail: other kinds never meet that code. A URL is its own body; text and HTML are read as
    UTF-8. Files that need a reader of their own (PDF, pictures) have an error and no body.
    """
    kinds = inputs.select(F.col(key).alias("_k"), F.col(data).alias("_d"), markup.kind_of(F.col(data), F.col(name)).alias("source_type"))
    none = F.lit(None).cast("string")
    mail = kinds.filter("source_type = 'EMAIL'").select("_k", "source_type", markup.message(F.col("_d")).alias("m"))
    mail = mail.select("_k", "source_type", F.coalesce("m.text", markup.plain_text(F.col("m.html")), F.lit("")).alias("body"), F.col("m.subject").alias("subject"), F.col("m.from_address").alias("sender"), none.alias("error"))
    plain = kinds.filter("source_type in ('URL', 'TEXT')").select("_k", "source_type", F.when(F.col("source_type") == "URL", F.regexp_replace(F.try_validate_utf8("_d"), r"^\s+|\s+$", "")).otherwise(F.try_validate_utf8("_d")).alias("body"), none.alias("subject"), none.alias("sender"), none.alias("error"))
    other = kinds.filter("source_type in ('PDF', 'IMAGE')").select("_k", "source_type", F.lit("").alias("body"), none.alias("subject"), none.alias("sender"), F.concat(F.lower("source_type"), F.lit("_reader_unavailable")).alias("error"))
    rows = mail.unionByName(plain).unionByName(other)
    links = F.when(F.col("source_type") == "URL", F.array("body")).otherwise(urls.find_urls(F.col("body")))
    return rows.select(F.col("_k").alias(key), "source_type", "body", "subject", "sender", links.alias("urls"), F.sha2(text.hash_text(F.col("body")), 256).alias("content_hash"), F.when(F.col("body").isNull(), "not_utf8").otherwise(F.col("error")).alias("error"))


def verified_domain(rows: DataFrame, host: str, listed: DataFrame, protected: tuple[str, ...]) -> DataFrame:
    """Rows with is_listed (the host or a parent of it is listed: domain) and imitates: not listed, but ending in a
    protected suffix."""
    hosts = rows.select(F.lower(F.trim(F.col(host))).alias("_h")).filter("_h is not null").distinct()
    known = by_suffix(hosts, "_h", listed.select(F.lower("domain").alias("host")).distinct()).select("_h", F.lit(True).alias("_ok"))
    h = F.lower(F.trim(F.col(host)))
    both = rows.join(known, h == F.col("_h"), "left").withColumn("is_listed", F.coalesce("_ok", F.lit(False)))
    ends = urls.any_of(h.endswith(s) & (h != s) for s in protected)
    return both.withColumn("imitates", F.coalesce(~F.col("is_listed") & ends, F.lit(False))).drop("_h", "_ok")


def official_contact(claims: DataFrame, key: str, claimed: str, register: DataFrame) -> DataFrame:
    """key with the registered entity that it names, and its contact: name, domains, contact, reg_no, by (exact, within).

    register has name, domains, contact and reg_no. Names are compared in their comparable form: equal ones first, the
    one with a contact, then domains, then a number before others (ties: by name); else the first name, in order, that
    holds the claimed one. Those meet on the claimed name's first three letters; names that aren't stated match nothing.
    """
    want = claims.select(key, text.company_name(F.col(claimed)).alias("_n")).filter("_n <> ''")
    known = register.select("name", "domains", "contact", "reg_no", text.company_name(F.col("name")).alias("_r"))
    facts = F.struct("name", "domains", "contact", "reg_no").alias("x")
    rank = F.struct(*[F.col(c).isNull().alias(c) for c in ("contact", "domains", "reg_no")], F.col("name"))
    exact = want.join(known, F.col("_n") == F.col("_r")).groupBy(key).agg(F.min_by(facts, rank).alias("x")).withColumn("by", F.lit("exact"))
    rest = want.join(exact.select(key), key, "left_anti").withColumn("_g", F.left("_n", F.lit(3)))
    grams = known.withColumn("_g", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_r"), F.lit(1))), lambda i: F.array(*[F.substring(F.col("_r"), i, F.lit(k)) for k in (1, 2, 3)])))))).filter("_g <> ''")
    within = rest.join(grams, "_g").filter(F.contains("_r", "_n")).groupBy(key).agg(F.min_by(facts, "name").alias("x")).withColumn("by", F.lit("within"))
    return exact.unionByName(within).select(key, "x.*", "by")


def reports(verdicts: DataFrame, reasons: DataFrame, registered: DataFrame, key: str, most: int = 6, least: int = 4) -> DataFrame:
    """key, route and body: a report on each message, for the office that it should go to.

    verdicts has key, verdict, confidence, summary, content_hash, entity, sender (null: not stated); reasons key, ord,
    severity, code, message, of which the first so many grave ones are listed; registered the keys whose entity is
    registered. Fraud in a registered entity's name goes to its supervisor, the rest to the office that takes it down.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "code"))
    grave = reasons.filter(F.col("severity") >= least).withColumn("_n", place).filter(F.col("_n") <= most)
    line = F.format_string("  - [%d] %s: %s", "severity", "code", "message")
    listed = grave.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    rows = verdicts.join(listed, key, "left").join(registered.select(key).distinct().withColumn("_reg", F.lit(True)), key, "left")
    route = F.when(F.col("verdict").isin("FRAUDULENT", "TAMPERED") & F.col("_reg"), "supervisor").otherwise("takedown")
    parts = [
        F.concat(F.lit("Report of suspected fraud: "), F.col("verdict"), F.lit(" (evidence "), F.col("confidence").cast("string"), F.lit("/100)")), F.concat(F.lit("Content (SHA-256): "), F.col("content_hash")),
        F.concat(F.lit("Claims to be: "), F.coalesce("entity", F.lit("not stated"))), F.concat(F.lit("Sent by: "), F.coalesce("sender", F.lit("unknown"))), F.lit("Findings:"), F.coalesce("_lines", F.lit("  - none of high severity")), F.concat(F.lit("Summary: "), F.col("summary")),
    ]
    return rows.select(key, route.alias("route"), F.array_join(F.array(*parts), "\n").alias("body"))


def analysis_rows(analyses: DataFrame, first: int = 0) -> DataFrame:
    """What is stored of analyses (kind, score, band, headline, issuer, tickers, source): names that aren't stated are
    empty, tickers are joined, and the whole is kept as JSON too."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.to_json(F.struct("band", "headline", "kind", "score", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers")))
    return analyses.select("kind", F.col("score").alias("risk_score"), "band", "headline", empty("issuer").alias("claimed_issuer"), F.array_join(F.coalesce("tickers", F.array().cast("array<string>")), ",").alias("tickers"), empty("source").alias("source"), whole.alias("verdict_json"))


def feed_flagged(feed: Column, answer: Column) -> Column:
    """Whether a feed's answer (JSON text) marks a URL as a threat; no answer and unknown feeds mark nothing."""
    v = F.try_parse_json(answer)
    true = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    out = F.when(feed == "virustotal", F.coalesce(F.try_variant_get(v, "$.score", "double") > 0.1, F.lit(False))).when(feed == "ipqualityscore", true(UNSAFE[0]) | true(UNSAFE[1]) | true(UNSAFE[2]))
    for name, field in FEEDS.items():
        out = out.when(feed == name, true(field))
    return out.otherwise(F.lit(False))


def address(c: Column) -> Column:
    """display and domain of a From line: what stands before an address in angle brackets, unquoted; the domain in
    comparable form, of the address or else of the first one in the line."""
    display = F.trim(F.regexp_replace(F.regexp_extract(c, r"^\s*([^<@]*?)\s*<[^<>]*>", 1), '^"|"$', ""))
    where = F.regexp_extract(c, r"(?:<[^<>@]*@([A-Za-z0-9.-]+)>|@([A-Za-z0-9.-]+))", 0)
    domain = text.domain(F.regexp_replace(F.regexp_replace(where, "^<?[^@]*@", ""), ">$", ""))
    return F.struct(F.nullif(display, F.lit("")).alias("display"), F.nullif(domain, F.lit("")).alias("domain"))


def forwarded_entity(rows: DataFrame, key: str, sender: str, body: str, owners: DataFrame, names: DataFrame) -> DataFrame:
    """key, entity and by of forwarded messages: whom the original claimed to be from. Its display name first, then the
    owner of its domain, and only then a company that the text names. owners has domain, entity; names name, normalised."""
    rows = rows.select(F.col(key).alias("_k"), address(F.coalesce(F.col(sender), F.lit(""))).alias("_a"), F.col(body).alias("_b"))
    open_ = rows.filter("_a.display is null")
    own = owners.groupBy("domain").agg(F.min("entity").alias("_owner"))
    held = open_.join(own, F.col("_a.domain") == F.col("domain"), "left")
    inside = longest_name(names_in_text(held.filter("_owner is null"), "_k", "_b", names), "_k")
    rest = held.select("_k", "_owner").join(inside, "_k", "left")
    told = rows.filter("_a.display is not null").select("_k", F.col("_a.display").alias("entity"), F.lit("display").alias("by"))
    rest = rest.select("_k", F.coalesce("_owner", "name").alias("entity"), F.when(F.col("_owner").isNotNull(), "domain").when(F.col("name").isNotNull(), "text").alias("by"))
    return told.unionByName(rest).withColumnRenamed("_k", key)


def support_script(cases: DataFrame, key: str, lines: DataFrame, brand: str, rails: str) -> DataFrame:
    """key and script of cases: what to say to a helpline, of lines stated by language and slot.

    cases has key, language, incident, mode, lost_money, a brand (null: unknown) and an array of offices to turn to;
    lines has language, slot (opening, close; fact:<mode> or fact:<incident> or fact:*; ask:lost, ask:two, ask:one) and
    template with {brand}, {first} and {second}. A mode's line goes before an incident's; a language without lines is
    the first language's, in order.
    """
    first = lines.agg(F.min("language").alias("_first"))  # one row
    spoken = lines.groupBy("language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "template")))).alias("_t"))  # some lines a language
    other = spoken.join(first, F.col("language") == F.col("_first")).select(F.col("_t").alias("_o"))
    rows = cases.join(spoken, "language", "left").crossJoin(other).withColumn("_t", F.coalesce("_t", "_o"))  # other is one row
    pick = lambda *slots: F.coalesce(*[F.try_element_at(F.col("_t"), s) for s in slots])
    office = lambda i: F.try_element_at(F.col(rails), F.lit(i))
    ask = F.when(F.col("lost_money"), pick(F.lit("ask:lost"))).when(office(2).isNotNull(), pick(F.lit("ask:two"))).otherwise(pick(F.lit("ask:one")))
    said = F.array_join(F.array(pick(F.lit("opening")), pick(F.concat(F.lit("fact:"), F.coalesce("mode", F.lit(""))), F.concat(F.lit("fact:"), F.coalesce("incident", F.lit(""))), F.lit("fact:*")), ask, pick(F.lit("close"))), "\n")
    for name, value in (("brand", F.col(brand)), ("first", office(1)), ("second", office(2))):
        said = F.replace(said, F.lit("{" + name + "}"), F.coalesce(value, F.lit({"brand": "the sender", "first": "the official office"}.get(name, ""))))
    return rows.select(key, said.alias("script"))


def funnel_name(name: Column, any_token: bool = False) -> Column:
    """Words of a chat's name that speak of securities; with any_token, generic words of sales channels too."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    about = SECURITIES_NAMES + (GENERIC_NAMES if any_token else ())
    return F.array_sort(F.filter(words, lambda w: w.isin(*about)))


def negative_control(contexts: DataFrame, group: str, name: str, scored: Column) -> DataFrame:
    """Of legitimate contexts, how many a name rule would accuse, in its tuned and in its broad form: group, mode, n,
    fired (the name matches) and accused (and the message is scored as well)."""
    each = contexts.select(group, scored.alias("_s"), F.explode(F.array(F.struct(F.lit("tuned").alias("mode"), (F.size(funnel_name(F.col(name))) > 0).alias("hit")), F.struct(F.lit("broad").alias("mode"), (F.size(funnel_name(F.col(name), True)) > 0).alias("hit")))).alias("m")).select(group, "_s", "m.*")
    return each.groupBy(group, "mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("fired"), F.count_if(F.col("hit") & F.coalesce("_s", F.lit(False))).alias("accused"))


def actions(verdict: Column, registered: Column, sent_money: Column, contact: Column) -> Column:
    """What to do after a verdict, most urgent first: priority and type of each step."""
    bad = verdict.isin("FRAUDULENT", "TAMPERED")
    step = lambda test, priority, kind: F.when(test, F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("type")))
    steps = [
        step(bad, "IMMEDIATE", "DO_NOT"), step(verdict == "UNVERIFIED", "IMMEDIATE", "VERIFY"), step(bad & F.coalesce(sent_money, F.lit(False)), "IMMEDIATE", "REPORT_LOSS"), step(contact.isNotNull(), "HIGH", "OFFICIAL_CONTACT"),
        step(bad & F.coalesce(registered, F.lit(False)), "HIGH", "REPORT_SUPERVISOR"), step(bad & ~F.coalesce(registered, F.lit(False)), "HIGH", "REPORT_TAKEDOWN"), step(bad, "MEDIUM", "SHARE"), step(~bad & (verdict != "UNVERIFIED"), "INFO", "SAFE_TO_READ"),
    ]
    return F.array_compact(F.array(*steps))


def media_summary(items: Column, pictures: int = 5, codes: int = 4, title: int = 120, value: int = 200) -> Column:
    """Numbers of pictures and codes among a page's media (kind, value), and the first few of each, cut at a length with
    three dots."""
    of = lambda kind: F.filter(F.coalesce(items, F.array()), lambda x: x["kind"] == kind)
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)
    shown = lambda kind, most, n: F.transform(F.slice(of(kind), 1, most), lambda x: cut(x["value"], n))
    return F.struct(F.size(of("image")).alias("n_images"), F.size(of("qr")).alias("n_codes"), shown("image", pictures, title).alias("images"), shown("qr", codes, value).alias("codes"))


def structural_check(handles: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """What a payment address is by structural rules alone (handle, category): key, category (UNKNOWN without a rule),
    validated, and source, which says that no register was asked. Rules go by what stands behind the at sign."""
    own = rules.select(F.lower(F.ltrim("pattern", F.lit("@"))).alias("_s"), "category").groupBy("_s").agg(F.min("category").alias("category"))
    rows = handles.select(key, F.lower(F.substring_index("handle", "@", -1)).alias("_h")).join(own, F.col("_h") == F.col("_s"), "left")
    return rows.select(key, F.coalesce("category", F.lit("UNKNOWN")).alias("category"), F.coalesce(F.col("category") == "VALID_INTERMEDIARY", F.lit(False)).alias("validated"), F.lit("local_structural_rules").alias("source"))


def gateway_rows(verdicts: DataFrame, codes: int = 12) -> DataFrame:
    """What is stored of verdicts that the gateway gave (message_id, verdict, confidence, codes, filing, from_addr, to_addr,
    subject, content_hash, latency_ms): addresses and ids at the lengths of their columns, the first so many codes."""
    cut = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n)).alias(c)
    return verdicts.select("content_hash", F.lit("EMAIL").alias("source_type"), F.lit("GATEWAY").alias("channel"), "verdict", "confidence", F.slice(F.coalesce("codes", F.array().cast("array<string>")), 1, codes).alias("codes"), F.col("filing").alias("matched_filing_id"), "latency_ms", cut("message_id", 998), cut("from_addr", 320), cut("to_addr", 998), "subject")


def sources_of(directory: DataFrame, category: str | None = None) -> DataFrame:
    """Official sources of a category; all of them without one."""
    return directory if not category else directory.filter(F.col("category") == category)
