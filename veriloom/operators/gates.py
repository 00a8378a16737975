"""Filters and gates over messages, URLs, files, forms and clipboards, as Column functions.

Packs (phrases, patterns, weights) are parameters; the defaults are small packs of this engine's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.entities import IFSC, every, handles

ASKS = ("send money", "pay now", "share your otp", "click here", "download", "join our")
NEGATED_ADVICE = r"\b(?:never|do not|don't)\s+(?:share|send|pay|click|download)[^.\n]*"
AWARENESS = ("beware", "do not share", "report fraud", "stay alert", "official advisory")
LEXICON = ("securities", "stock", "broker", "demat", "dividend", "ipo", "portfolio", "trading")
INJECTION = r"ignore (?:all |the )?previous instructions|system prompt|disregard the above"
IDENTITY = r"\bi am (?:the )?(?:admin|regulator|support)\b"
ACTIONS = {"display": 0, "link": 10, "payment": 40}
DANGEROUS = ("exe", "apk", "scr", "bat", "js", "vbs", "msi")
SENSITIVE = (("otp|pin|cvv|password", 40), ("card|account|iban", 30), ("aadhaar|pan|ssn", 25), ("phone|email", 10))


def count_of(c: Column, phrases) -> Column:
    """How many of the phrases a text holds."""
    return reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in phrases], F.lit(0))


def weighted(c: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the phrases that a text holds."""
    return reduce(lambda a, b: a + b, [F.when(c.contains(p), w).otherwise(0) for p, w in weights.items()], F.lit(0))


def firsts(*cases) -> Column:
    """An array of the values whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, F.lit(value)) for value, test in cases]))


def asking(c: Column, asks=ASKS) -> Column:
    return (count_of(F.lower(c), asks) > 0) | c.contains("?")


def has_ask(c: Column, asks=ASKS) -> Column:
    """A request for value, once advice against it is taken out, or a payment handle."""
    rest = F.regexp_replace(F.lower(c), NEGATED_ADVICE, " ")
    return (count_of(rest, asks) > 0) | (F.size(handles(c)) > 0)


def awareness(c: Column, markers=AWARENESS, least: int = 2) -> Column:
    return (count_of(F.lower(c), markers) >= least) & (F.size(handles(c)) == 0) & (F.size(every(c, IFSC)) == 0)


def negated(c: Column, phrase: str, back: int = 42, cues: str = r"\b(?:no|not|never|without)\b") -> Column:
    """Whether a cue stands within so many characters before the first place of a phrase."""
    at = F.locate(phrase, F.lower(c))
    return (at > 0) & F.substring(F.lower(c), F.greatest(at - back, F.lit(1)), F.least(at - 1, F.lit(back))).rlike(cues)


def near(c: Column, needle: str, pattern: str, window: int = 140) -> Column:
    """Whether a pattern matches within so many characters of the first place of a literal."""
    at = F.locate(needle, c)
    return (at > 0) & F.substring(c, F.greatest(at - window, F.lit(1)), F.lit(2 * window + len(needle))).rlike(pattern)


def context(c: Column, words) -> Column:
    return count_of(F.lower(c), words) > 0


def gated(matched: Column, gated_words, act: Column) -> Column:
    """Whether a category scores: some matched keyword isn't gated, or there is an act."""
    return (F.size(F.array_except(matched, F.array(*map(F.lit, gated_words)))) > 0) | act


def cap_alone(score: Column, categories: Column, hard: Column, cap: int = 35) -> Column:
    """At most one keyword category and no hard evidence: the score stops at the cap."""
    return F.when((F.size(F.array_distinct(categories)) <= 1) & ~hard, F.least(score, F.lit(cap))).otherwise(score)


def lexicon(c: Column, words=LEXICON, least: int = 2) -> Column:
    return count_of(F.lower(c), words) >= least


def scope(c: Column, channel: Column, words=LEXICON, framing=("invest", "returns", "profit")) -> Column:
    """Triggers that put a message in scope: lexicon, payment with framing, registration token, channel."""
    t = F.lower(c)
    return firsts(("T0", lexicon(c, words)), ("T1", (F.size(handles(c)) > 0) & context(c, framing)), ("T2", t.rlike(r"\bin[abdehimnprz][0-9]{6,9}\b")), ("T3", channel))


def input_gate(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.rlike(INJECTION), "BLOCK").when(t.rlike(IDENTITY), "WARN").otherwise("ALLOW")


def output_gate(c: Column, action: Column) -> Column:
    """ALLOW, REVIEW or BLOCK by the action's and the text's risk."""
    act = F.lit(0)
    for k, v in ACTIONS.items():
        act = F.when(action == k, v).otherwise(act)
    risk = act + F.when(F.lower(c).contains("http"), 20).otherwise(0) + F.when(c.rlike(r"[0-9]{9,}"), 20).otherwise(0)
    return F.when(risk >= 60, "BLOCK").when(risk >= 30, "REVIEW").otherwise("ALLOW")


def url_gate(url: Column) -> Column:
    bad = url.rlike(r"(?i)^(javascript|data|vbscript):") | url.rlike(r"(?i)\.(exe|apk|scr|bat|msi)(\?|#|$)")
    warn = url.startswith("http://") | (F.length(url) > 200) | (F.regexp_count(url, F.lit(r"(?i)[?&](url|redirect|next|goto)=")) >= 2)
    return F.when(bad, "BLOCK").when(warn, "WARN").otherwise("ALLOW")


def download_gate(name: Column, kind: Column) -> Column:
    last = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    double = name.rlike(r"(?i)\.(pdf|jpg|png|docx?)\.[a-z0-9]+$")
    mismatch = ((last == "pdf") & (kind != "application/pdf")) | (last.isin("jpg", "png") & ~kind.startswith("image/"))
    return F.when(last.isin(*DANGEROUS) | double, "BLOCK").when(mismatch, "WARN").otherwise("ALLOW")


def form_gate(fields: Column, trusted: Column) -> Column:
    """Greatest sensitivity of a form's fields, each by the first pattern that fits; none on a trusted domain."""

    def one(f: Column) -> Column:
        out = F.lit(0)
        for p, w in reversed(SENSITIVE):
            out = F.when(F.lower(f).rlike(p), w).otherwise(out)
        return out

    return F.when(trusted, 0).otherwise(F.coalesce(F.array_max(F.transform(fields, one)), F.lit(0)))


def clipboard_gate(c: Column) -> Column:
    """Kinds of personal data on a clipboard."""
    return firsts(("card", c.rlike(r"\b[0-9]{13,19}\b")), ("ip", c.rlike(r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b")), ("email", c.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}")))


def allowed(rows: DataFrame, address: str, exact: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows whose address is listed, or its domain is; no lists, no rows."""
    of = F.lower(F.regexp_extract(F.col(address), "@(.*)$", 1))
    a = rows.join(exact.select(F.lower("value").alias("_v")), F.lower(F.col(address)) == F.col("_v"), "left_semi")
    rest = rows.join(exact.select(F.lower("value").alias("_v")), F.lower(F.col(address)) == F.col("_v"), "left_anti")
    return a.unionByName(rest.join(domains.select(F.lower("value").alias("_v")), of == F.col("_v"), "left_semi"))


def blocked_claims(docs: DataFrame, pattern: str, back: int = 120, cues: str = r"\b(?:not|no|never)\b") -> DataFrame:
    """Lines with a claim that isn't negated within so many characters before it; every claim of a line is looked at."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike(pattern))
    pieces, found = F.split("text", pattern), F.regexp_extract_all("text", F.lit(f"(?:{pattern})"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.length(x["f"])).alias("at"), F.array_append(s["all"], s["at"] + F.length(x["p"])).alias("all"))
    places = F.aggregate(F.filter(F.arrays_zip(pieces.alias("p"), found.alias("f")), lambda x: x["f"].isNotNull()), start, step, lambda s: s["all"])
    before = lambda at: F.substring(F.col("text"), F.greatest(at - back + 1, F.lit(1)), F.least(at, F.lit(back)))
    return lines.filter(F.exists(places, lambda at: ~before(at).rlike(cues))).select("doc_id", "line")


#: Words that say that a notice replaces another.
AMENDED = ("amended", "amendment", "corrigendum", "revised")


def amended(c: Column, words=AMENDED) -> Column:
    """Whether a filing's text says that it amends another."""
    return F.lower(c).rlike(r"\b(?:" + "|".join(words) + r")\b")


def authority_demand(c: Column, authority: str, demands, disclaimer: str) -> Column:
    """Whether a text speaks for an authority and demands something, without disclaiming it."""
    return c.rlike(authority) & (count_of(c, demands) > 0) & ~F.lower(c).rlike(disclaimer)
