"""Smaller readings: tactics, ranks, incidents, channels, histories, freshness and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.lookups import entity_ties, shared_entities
from veriloom.operators.rollups import latest
from veriloom.operators.scoring import band, choose, clamp, prf
from veriloom.operators.similar import connected
from veriloom.sources.shared import kept

# Orders of verdicts and tiers, edges of confidence and of distances.
VERDICT_ORDER = ("safe", "unverified", "suspicious", "dangerous")
VISUAL, SEMANTIC, LEXICAL = (10, 20), 0.82, 0.90
READ_WELL, READ_FAIRLY = 0.85, 0.5


def tactics(c: Column, pack: list[tuple[str, str]]) -> Column:
    """Tactics that a text uses, in the order of the pack (name, pattern), each with the words that show it."""
    hit = [F.when(c.rlike(p), F.struct(F.lit(n).alias("tactic"), F.regexp_extract(c, f"({p})", 1).alias("cue"))) for n, p in pack]
    return F.array_compact(F.array(*hit))


def worse(a: Column, b: Column) -> Column:
    """The worse of two verdicts; one that isn't known counts as none."""
    rank = lambda v: choose(v, {k: i for i, k in enumerate(VERDICT_ORDER)}, -1)
    return F.when(F.coalesce(rank(a), F.lit(-1)) >= F.coalesce(rank(b), F.lit(-1)), a).otherwise(b)


def not_titled(found: Column, titles: Column) -> Column:
    """Found items whose title isn't among the given ones, whatever the case."""
    low = F.transform(titles, lambda x: F.lower(x))
    return F.filter(found, lambda x: ~F.array_contains(low, F.lower(x)))


def lanes(**parts: tuple[Column, int]) -> Column:
    """One flat list of the signals of several lanes, tagged with the lane, so many of each at most; a null lane is empty."""
    none = F.array().cast("array<string>")
    tag = lambda k: lambda x: F.concat(F.lit(f"[{k}] "), x)
    return F.flatten(F.array(*[F.transform(F.slice(F.coalesce(c, none), 1, n), tag(k)) for k, (c, n) in parts.items()]))


def advice(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The recommendations whose condition holds, in their order; one of its own where none does."""
    got = F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in cases]))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(otherwise)))


def read_confidence(value: Column, confidence: Column) -> Column:
    """How well a field was read: fields that aren't from a picture (null confidence) count as well read."""
    return F.when(confidence.isNull() | (confidence >= READ_WELL), "HIGH").when(confidence >= READ_FAIRLY, "MEDIUM").otherwise("UNREADABLE")


def match_tier(same_hash: Column, distance: Column, matched: Column, conflicts: Column, cosine: Column, lexical: Column) -> Column:
    """Tier of a match by what proves most: equal hash, near picture, agreeing fields, near meaning or wording."""
    near, far = VISUAL
    return (
        F.when(same_hash, "EXACT").when(distance < near, "VISUAL").when((distance <= far) & (conflicts == 0), "VISUAL_WEAK").when(matched >= 2, "STRUCTURED")
        .when((cosine >= SEMANTIC) | (lexical >= LEXICAL), "SEMANTIC").otherwise("NONE")
    )


def z_score(volume: Column, ret: Column, saturation: float = 4.0) -> Column:
    """Score of two z values: the greater one's size over the saturation, 0 to 1."""
    return clamp(F.greatest(F.abs(F.coalesce(volume, F.lit(0.0))), F.abs(F.coalesce(ret, F.lit(0.0)))) / saturation, 0.0, 1.0)


def app_offer(name: Column, brands: tuple[str, ...], claims: tuple[str, ...], linked: Column) -> Column:
    """What a file name says of an app file: whether it is one, which claims it makes, a brand, a disguise, severity."""
    low = F.lower(name)
    app = low.rlike(r"\.apk(\.[a-z]+)?$")
    disguised = low.rlike(r"\.apk\.[a-z]+$") | low.rlike(r"\.(pdf|jpg|docx?)\.apk$")
    made = F.array_compact(F.array(*[F.when(low.contains(c), c) for c in claims]))
    brand = F.lit(False)
    for b in brands:
        brand = brand | low.contains(b)
    severity = F.when(~app, "none").when(disguised | (brand & (F.size(made) > 0)), "high").when(brand | (F.size(made) > 0) | linked, "medium").otherwise("low")
    return F.struct(app.alias("app"), made.alias("claims"), (app & brand).alias("brand"), (app & disguised).alias("disguised"), severity.alias("severity"))


def incident(c: Column, kinds: list[tuple[str, tuple[str, ...]]], otherwise: str = "general") -> Column:
    """Kind of incident of a text: the first in the order of the kinds that has a word in it."""
    low, out = F.lower(c), F.lit(otherwise)
    for name, words in reversed(kinds):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def file_kind(name: Column, mime: Column) -> Column:
    """Kind of a file by its suffix, else by its MIME type."""
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("mp4", "mov", "webm"), "video").when(end.isin("mp3", "wav", "ogg"), "audio").when(end.isin("jpg", "png", "webp"), "image").when(end == "pdf", "pdf").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").when(mime.startswith("image/"), "image").otherwise("text")


def picture_kind(width: Column, height: Column, dominant: Column) -> Column:
    """Kind of a picture from its sides and the share of its commonest colour: tall ones are phone screens, plain ones documents."""
    ratio = F.try_divide(height, width)
    return F.when(width.isNull() | height.isNull() | (width <= 0), "unknown").when(ratio >= 1.6, "phone_screenshot").when(dominant >= 0.5, "document").when(ratio <= 0.7, "desktop_screenshot").otherwise("photo")


def relevant_filing(category: Column, subcategory: Column, body: Column, targets: tuple[str, ...]) -> Column:
    """Whether a filing is worth its PDF: a target subcategory, a meeting, or words on dividends and votes."""
    sub = F.lit(False)
    for t in targets:
        sub = sub | F.lower(subcategory).contains(t)
    return F.coalesce(sub, F.lit(False)) | F.coalesce(F.lower(category).rlike(r"\b(agm|egm)\b"), F.lit(False)) | F.coalesce(F.lower(body).rlike("dividend|e-voting|record date"), F.lit(False))


def channel_flags(messages: DataFrame, chat: str, sender: str, body: str, funnel: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Flags of each chat: one sender writes most of it, links out of the platform, forwarded marks, words of a funnel."""
    by = messages.groupBy(chat, sender).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(body).contains("http")).alias("out"), F.max(F.col(body).rlike(r"(?i)\bforwarded\b|^> ")).alias("fwd"), F.max(F.col(body).rlike(funnel)).alias("funnel"))
    all_ = by.groupBy(chat).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("out").alias("out"), F.max("fwd").alias("fwd"), F.max("funnel").alias("funnel"))
    tests = (("skewed_poster_ratio", (F.col("most") >= share * F.col("n")) & (F.col("n") >= least)), ("off_platform_links", F.col("out")), ("forwarded_content", F.col("fwd")), ("funnel_words", F.col("funnel")))
    return all_.select(chat, "n", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests])).alias("flags"))


def campaigns(sightings: DataFrame, days: int = 30, least: int = 2) -> DataFrame:
    """obs and campaign (its least observation) of observations that share so many entities within so many days."""
    ties = entity_ties(sightings, days) if least == 2 else shared_entities(sightings, days, least)
    return connected(ties).select(F.col("id").alias("obs"), F.col("component").alias("campaign"))


def join_campaigns(members: DataFrame, sightings: DataFrame, fresh: DataFrame, days: int = 30, least: int = 2) -> DataFrame:
    """Campaigns after new observations came in: members (obs, campaign) so far, sightings of all, obs of the new ones.

    Pairs are looked for among those entities only that a new observation has; a new observation joins the campaign
    that it shares enough with, may tie two of them together, or seeds one with another.
    """
    touched = sightings.join(sightings.join(fresh, "obs", "left_semi").select("type", "value").distinct(), ["type", "value"], "left_semi")
    pairs = entity_ties(touched, days) if least == 2 else shared_entities(touched, days, least)
    edges = pairs.select("a", "b").unionByName(members.filter("obs <> campaign").select(F.col("campaign").alias("a"), F.col("obs").alias("b")))
    return connected(edges).select(F.col("id").alias("obs"), F.col("component").alias("campaign"))


def campaign_list(members: DataFrame, observations: DataFrame, most: int = 50) -> DataFrame:
    """Campaigns with number of members, first and last time, the newest first. observations has obs, ts, channel."""
    rows = members.join(observations, "obs").groupBy("campaign").agg(F.count(F.lit(1)).alias("members"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("channel").alias("channels"))
    return rows.orderBy(F.desc("last_seen"), "campaign").limit(most)


def history(rows: DataFrame, key: str, verdict: str, order: str, most: int) -> DataFrame:
    """Counts of each key's verdicts and its newest rows: key, all, bad, and the orders of the last so many, newest first."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr(verdict)).alias("bad"))
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_n") <= most)
    return n.join(last.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("last")), key).select(key, "all", "bad", F.reverse("last").alias("last"))


def freshness(sources: DataFrame, source: str, as_of: str, now: Column, days: int) -> DataFrame:
    """Newest date of each source, its age, and whether it is stale."""
    got = sources.groupBy(source).agg(F.max(as_of).alias("as_of"))
    age = F.datediff(now, F.col("as_of"))
    return got.select(source, age.alias("age_days"), (F.coalesce(age, F.lit(days + 1)) > days).alias("stale"))


def evaluated(rows: DataFrame, expected: str, got: str, accusing: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact accuracy, false accusations and precision of accusations, of all rows or by some columns."""
    hit = F.col(got).isin(*accusing)
    right = F.col(expected).isin(*accusing)
    n = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(expected) == F.col(got)).alias("exact"), F.count_if(hit & ~right).alias("false_accusations"), F.count_if(hit & right).alias("tp"), F.count_if(~hit & right).alias("fn"))
    p = prf(F.col("tp"), F.col("false_accusations"), F.col("fn"))
    return n.select(*(by or []), "n", F.round(F.col("exact") / F.col("n"), 6).alias("accuracy"), "false_accusations", F.round(p["precision"], 6).alias("precision"), F.round(p["recall"], 6).alias("recall"))


def by_configuration(rows: DataFrame, score: str, truth: str, edges: dict[str, float]) -> DataFrame:
    """False positives and hits of each configuration's threshold, in one pass over the rows."""
    configs = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.lit(float(v)).alias("edge")) for k, v in edges.items()])).alias("c")
    each = rows.select(score, truth, configs)
    said = F.col(score) >= F.col("c.edge")
    return each.groupBy(F.col("c.config").alias("config")).agg(F.count_if(said & (F.col(truth) == 0)).alias("false_positives"), F.count_if(said & (F.col(truth) == 1)).alias("hits"), F.count(F.lit(1)).alias("n"))


def agreement(fields: DataFrame, key: str) -> DataFrame:
    """Of fields with agrees: how many could be compared, matched and conflicted, and the score of the match."""
    n = fields.groupBy(key).agg(F.count(F.lit(1)).alias("comparable"), F.count_if("agrees").alias("matched"), F.count_if(~F.col("agrees")).alias("conflicts"))
    return n.withColumn("score", F.round(F.least(F.lit(1.0), 0.75 + 0.08 * F.col("matched")), 4))


def official_match(host: Column, official: Column, brands: tuple[str, ...], skeleton=None, cut: str = r"[.-]") -> Column:
    """How a host relates to official ones (an array): exact, stuffing (an official name within another's), confusable
    (same skeleton, if one is given), brand_token (between places that match cut), none."""
    exact = F.exists(official, lambda o: (host == o) | host.endswith(F.concat(F.lit("."), o)))
    stuffed = F.exists(official, lambda o: host.contains(F.concat(o, F.lit("."))) | host.contains(F.concat(o, F.lit("-"))))
    alike = F.exists(official, lambda o: skeleton(host) == skeleton(o)) if skeleton else F.lit(False)
    token = F.lit(False)
    for b in brands:
        token = token | F.array_contains(F.split(host, cut), b)
    return F.when(exact, "exact").when(stuffed, "stuffing").when(alike, "confusable").when(token, "brand_token").otherwise("none")


def identity_state(domain: Column, handle_inside: Column, registration: Column) -> Column:
    """Identity from the domain's match, the payment namespace and the registration: the gravest that speaks."""
    return F.when(registration == "collision", "mismatch").when(domain.isin("stuffing", "confusable"), "imitation").when(registration == "invalid", "invalid").when(handle_inside == F.lit(False), "outside_namespace").when((domain == "exact") & (registration == "valid"), "confirmed").when(domain == "exact", "official").otherwise("unverified")


def latest_within(rows: DataFrame, key: str, time: str, now: Column, hours: int) -> DataFrame:
    """What a cache still holds: the newest row of each key that is not older than so many hours."""
    return latest(rows.filter(F.col(time) > now - F.expr(f"interval {hours} hours")), [key], [F.col(time).desc()])


def spaced(rows: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """Rows with allowed: whether a call comes so many seconds after the last allowed one of its key.

    Every call points to the first one that is late enough after it; those that the first call of a key leads to are
    allowed. They are found by doubling: each round follows pointers of twice the length from all that are known, so that
    the rounds grow with the logarithm of a key's calls. Calls without key or time aren't allowed.
    """
    gap = int(seconds * 1_000_000)
    times = rows.select(F.col(key).alias("k"), F.unix_micros(time).alias("us")).filter("k is not null and us is not null").distinct()
    asked = times.select("k", "us", F.lit(True).alias("point")).unionByName(times.select("k", (F.col("us") + gap).alias("us"), F.lit(False).alias("point")))
    back = Window.partitionBy("k").orderBy(F.desc("us"), F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.withColumn("to", F.min(F.when(F.col("point"), F.col("us"))).over(back)).filter("not point and to is not null")
    jump = kept(found.select("k", (F.col("us") - gap).alias("us"), "to"), "jumps")
    allowed = kept(times.groupBy("k").agg(F.min("us").alias("us")), "allowed")
    while True:
        more = kept(allowed.join(jump, ["k", "us"]).select("k", F.col("to").alias("us")), "allowed")
        if more.isEmpty():
            break
        allowed = kept(allowed.unionByName(more), "allowed")
        jump = kept(jump.join(jump.select("k", F.col("us").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "us", F.col("far").alias("to")), "jumps")
    known = allowed.select(F.col("k").alias("_k"), F.col("us").alias("_us"), F.lit(True).alias("_ok"))
    return rows.join(known, (F.col(key) == F.col("_k")) & (F.unix_micros(time) == F.col("_us")), "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_k", "_us", "_ok")


def risk_client(score: Column) -> Column:
    """Risk level with the client's edges."""
    return band(score, ((80, "LOW"), (50, "MODERATE"), (25, "HIGH")), "CRITICAL")


def poster_host(identity: Column) -> Column:
    """Host of a poster's identity: an address's domain, a URL's host, or a bare host; empty for a name."""
    h = F.regexp_replace(F.regexp_extract(F.lower(F.trim(identity)), r"^(?:[a-z]+://)?(?:[^/@\s]*@)?([a-z0-9.-]+\.[a-z]{2,})(?:[/:?#].*)?$", 1), r"^www\.", "")
    return h


def published_mark(domains: DataFrame, domain: str, records: DataFrame, checked: Column) -> DataFrame:
    """Cached records of verified marks: found and has_vmc of each domain; a domain without a record isn't checked."""
    r = records.select(F.lower("domain").alias("_d"), F.col("certificate").isNotNull().alias("has_vmc"))
    both = domains.join(r, F.lower(domain) == F.col("_d"), "left")
    return both.select(*domains.columns, F.when(F.col("_d").isNotNull(), "found").when(checked, "none").otherwise("not_checked").alias("record"), F.coalesce("has_vmc", F.lit(False)).alias("has_vmc"))


def forward_marks(c: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """Names of the marks of forwarding that a picture's text holds."""
    low, out = F.lower(c), []
    for name, words in phrases.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out.append(F.when(hit, name))
    return F.array_compact(F.array(*out))


def candidate_dates(own: Column, found: Column, most: int = 8) -> Column:
    """Dates to look filings up by: those of fields first, then the first so many of the text, each once."""
    return F.array_distinct(F.concat(F.array_compact(own), F.slice(found, 1, most)))


def fingerprint(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, size)


def explanation(summaries: Column, otherwise: str) -> Column:
    """The summaries of available signals (structs of available and summary) as one text."""
    said = F.transform(F.filter(summaries, lambda s: s.available & (F.coalesce(s["summary"], F.lit("")) != "")), lambda s: s["summary"])
    return F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(F.lit(otherwise))


def preview_media(items: Column, kinds: tuple[str, ...] = ("image", "video")) -> Column:
    """URLs of a preview's items (structs of kind and url) of the kinds that can be looked at, web addresses only, each once."""
    return F.array_distinct(F.transform(F.filter(items, lambda x: x["kind"].isin(*kinds) & x["url"].rlike(r"^https?://")), lambda x: x["url"]))


def playbook(rows: DataFrame, key: str, kind: str, steps: DataFrame, most: int) -> DataFrame:
    """Steps of each row's kind and of every kind (*), by priority, each once, so many. steps has kind, priority, step."""
    dims = steps.select(F.col("kind").alias("_k"), "priority", "step")
    both = rows.select(key, F.explode(F.array(F.col(kind), F.lit("*"))).alias("_k")).join(dims, "_k").groupBy(key, "step").agg(F.min("priority").alias("priority"))
    placed = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("priority", "step"))).filter(F.col("_n") <= most)
    return placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "step"))).alias("s")).select(key, F.transform("s", lambda x: x["step"]).alias("steps"))


def drift(pairs: DataFrame, generation: str, distance: str) -> DataFrame:
    """Distances of copies to their originals by generation: mean, median, least and greatest."""
    return pairs.groupBy(generation).agg(F.round(F.avg(distance), 4).alias("mean"), F.percentile(distance, F.lit(0.5)).alias("median"), F.min(distance).alias("least"), F.max(distance).alias("most"), F.count(F.lit(1)).alias("n"))


def domain_ages(links: DataFrame, domain: str, registered: DataFrame, now: Column, young: int = 90) -> DataFrame:
    """Age in days of each domain, and whether it is young; a domain that isn't listed has no age, which is no finding."""
    both = links.join(registered.select(F.lower("domain").alias("_d"), "created"), F.lower(domain) == F.col("_d"), "left")
    age = F.datediff(now, F.col("created"))
    return both.select(*links.columns, age.alias("days"), F.coalesce(age < young, F.lit(False)).alias("young"))


def top_clusters(clusters: DataFrame, score: str, key: str, most: int = 5) -> DataFrame:
    return clusters.orderBy(F.desc(score), key).limit(most)


def all_hold(rows: DataFrame, state: str, good: str) -> DataFrame:
    """How many of some contracts there are, how many are good, and whether all are (an empty table isn't)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(state) == good).alias("good"))
    return n.withColumn("all_good", (F.col("n") > 0) & (F.col("n") == F.col("good")))
