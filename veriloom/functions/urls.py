"""Hosts, domains and URLs, as Column functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.text import host_suffixes

# Public suffixes of more than one label under .in, those of regulated banks and finance among them.
SECOND_LEVEL = ("insurance.in", "bank.in", "firm.in", "co.in", "gov.in", "nic.in", "org.in", "ac.in", "net.in", "edu.in", "res.in", "mil.in", "gen.in", "ind.in", "fin.in")
#: Suffix rules for general use; an exception is written with !, a wildcard with *.
SUFFIX_RULES = ("com", "org", "net", "in", "co.in", "gov.in", "bank.in", "uk", "co.uk", "org.uk", "ck", "*.ck", "!www.ck")
HIGH_RISK, MEDIUM_RISK = (".xyz", ".top", ".click", ".loan", ".zip"), (".info", ".biz", ".online", ".site", ".net")
TRUSTED = ("example.org", "regulator.gov.in", "exchange.example.com")
BRANDS = ("example", "orange", "payline", "zenbank", "nation")
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "is.gd")
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def host(url: Column) -> Column:
    """Host name of a URL, lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)", 1))


def tail(h: Column, labels: int) -> Column:
    return F.call_function("substring_index", h, F.lit("."), F.lit(-labels))


def plain_registrable(h: Column, multi=SECOND_LEVEL) -> Column:
    """Two labels, three where the last two are a known suffix; addresses stay."""
    h = F.regexp_replace(F.lower(F.trim(h)), r"^www\.|\.$", "")
    return F.when(h.rlike(IPV4), h).when(tail(h, 2).isin(*multi), tail(h, 3)).otherwise(tail(h, 2))


def without_www(h: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.trim(h)), F.lit(".")), r"^www\.", "")


def effective_tld(h: Column) -> Column:
    """The longest known suffix, else the last label."""
    h = F.rtrim(F.lower(F.trim(h)), F.lit("."))
    out = tail(h, 1)
    for s in sorted(SECOND_LEVEL, key=len):
        out = F.when((h == s) | h.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def registrable(h: Column) -> Column:
    """The label before the effective suffix, with the suffix."""
    h, etld = F.rtrim(F.lower(F.trim(h)), F.lit(".")), effective_tld(h)
    labels = F.size(F.split(etld, r"\.")) + 1
    return F.when(h == etld, h).otherwise(F.call_function("substring_index", h, F.lit("."), -labels))


def depth(h: Column) -> Column:
    """Labels before the registrable domain."""
    clean = F.rtrim(F.lower(F.trim(h)), F.lit("."))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\.")) - F.size(F.split(registrable(h), r"\.")))


def licensed_namespace(h: Column) -> Column:
    """Trust, suffix and domain of a host in a licensed namespace, else null."""
    kind = F.regexp_extract(F.lower(h), r"(?:^|\.)((?:bank|fin)\.in)$", 1)
    return F.when(kind != "", F.struct(kind.alias("suffix"), registrable(h).alias("domain"), F.lit(30).alias("delta")))


def public_suffix(h: Column, rules=SUFFIX_RULES) -> Column:
    """Public suffix of a host: an exception beats a wildcard, which beats the longest rule; else the last label."""
    all_ = host_suffixes(h)
    exact = [r for r in rules if r[0] not in "!*"]
    wild, excepted = [r[2:] for r in rules if r[0] == "*"], [r[1:] for r in rules if r[0] == "!"]
    parent = lambda s: F.regexp_replace(s, r"^[^.]*\.", "")
    first = lambda test: F.try_element_at(F.filter(all_, test), F.lit(1))
    by_exception = first(lambda s: s.isin(*excepted))
    by_wild = first(lambda s: s.contains(".") & parent(s).isin(*wild))
    return F.coalesce(F.when(by_exception.isNotNull(), parent(by_exception)), by_wild, first(lambda s: s.isin(*exact)), tail(h, 1))


def site(h: Column) -> Column:
    """Registrable domain, suffix, own label and number of subdomains by the public suffix rules."""
    suffix = public_suffix(h)
    n = F.size(F.split(suffix, r"\.")) + 1
    domain_ = F.when(h == suffix, F.lit(None)).otherwise(F.call_function("substring_index", h, F.lit("."), -n))
    return F.struct(domain_.alias("domain"), suffix.alias("suffix"), F.regexp_extract(domain_, r"^[^.]*", 0).alias("label"), F.when(domain_.isNotNull(), F.size(F.split(h, r"\.")) - n).alias("subdomains"))


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site(a)["domain"] == site(b)["domain"], F.lit(False))


def heuristic_domain(url: Column) -> Column:
    """Three labels where the second last is a general one, else two."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    second = F.try_element_at(F.split(h, r"\."), F.lit(-2))
    return F.when(second.isin("co", "gov", "org", "ac", "net") & (F.size(F.split(h, r"\.")) >= 3), tail(h, 3)).otherwise(tail(h, 2))


def safe_domain(url: Column) -> Column:
    """Registrable domain if its suffix is known and it looks like one, else null."""
    d = registrable(host(url))
    known = tail(d, 1).isin("com", "org", "net", "in", "uk") | effective_tld(d).isin(*SECOND_LEVEL)
    return F.when(known & d.rlike(r"^[a-z0-9-]{1,63}(\.[a-z0-9-]{1,63})+$"), d)


def find_urls(c: Column) -> Column:
    """URLs, www names and bare domains of a text, without closing marks, each once in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|in)\b[^\s<>\"')\]]*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def stated(c: Column, rest: str = r"[^\s<>\"')\]]+") -> Column:
    """URLs that a text states with their scheme, as often as it does."""
    return F.regexp_extract_all(c, F.lit(f"https?://{rest}"), F.lit(0))


def numeric_ipv4(h: Column) -> Column:
    """Dotted form of a host that is one number, decimal or hexadecimal, or dotted already; else null."""
    number = F.when(h.rlike(r"^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(h, 3, 8), 16, 10).try_cast("long")).when(h.rlike(r"^[1-9][0-9]{7,9}$"), h.try_cast("long"))
    part = lambda k: F.shiftright(number, k).bitwiseAND(F.lit(255)).cast("string")
    dotted = F.when(h.rlike(IPV4) & F.forall(F.split(h, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))), h)
    return F.coalesce(dotted, F.when(number < (1 << 32), F.concat_ws(".", *[part(k) for k in (24, 16, 8, 0)])))


def private_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit(False))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits."""
    chars, n = F.split(c, ""), F.length(c)
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    return F.when(n > 0, F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, ch: a - share(ch) * F.log2(share(ch)))).otherwise(F.lit(0.0))


def parameters(url: Column) -> Column:
    """Name and value of the query's parameters."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    pair = lambda p: F.struct(F.regexp_extract(p, r"^[^=]*", 0).alias("name"), F.regexp_extract(p, r"=(.*)$", 1).alias("value"))
    return F.transform(F.filter(F.split(q, "&"), lambda p: p != ""), pair)


def single_use_token(url: Column) -> Column:
    """Whether a parameter is named like a token, or has a long value of high entropy."""
    return F.exists(parameters(url), lambda p: F.lower(p["name"]).isin("token", "otp", "session", "sid", "auth", "code") | ((F.length(p["value"]) >= 16) & (entropy(p["value"]) >= 3.2)))


def anchor_mismatch(text: Column, url: Column) -> Column:
    """Whether the visible text looks like a URL of another registrable domain than the link's."""
    shown = F.lower(F.regexp_extract(text, r"(?i)\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b", 1))
    return (shown != "") & (registrable(shown) != registrable(host(url)))


def credential_in_url(url: Column) -> Column:
    return url.rlike(r"(?i)[?&](email|user|login|account)=[^&]*(@|%40)")


def parts(url: Column) -> Column:
    """Scheme, host, port, path, query, fragment and what is odd about them."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    user = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@", 1)
    h = host(url)
    kind = F.when(scheme.isin("http", "https"), "web").when(scheme.isin("upi", "paytmmp", "phonepe", "tez"), "payment").when(scheme.isin("javascript", "data", "vbscript"), "script").otherwise("other")
    return F.struct(
        scheme.alias("scheme"), kind.alias("kind"), h.alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1).alias("port"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"), F.regexp_extract(url, r"#(.*)$", 1).alias("fragment"),
        (user != "").alias("has_user"), h.contains("xn--").alias("punycode"), numeric_ipv4(h).isNotNull().alias("is_ip"),
        registrable(h).isin(*SHORTENERS).alias("shortener"),
    )


def should_resolve(url: Column) -> Column:
    """Why a URL must not be fetched, or `resolve`."""
    p = parts(url)
    return F.when(p["kind"] != "web", "scheme").when(private_ipv4(numeric_ipv4(p["host"])), "private").when(single_use_token(url), "token").otherwise("resolve")


def tld_risk(h: Column) -> Column:
    ends = lambda tlds: any_of(h.endswith(t) for t in tlds)
    return F.when(ends(HIGH_RISK), "high").when(ends(MEDIUM_RISK), "medium").otherwise("safe")


def typosquat(h: Column, brands=BRANDS) -> Column:
    """The first brand that the second-level label imitates: two edits or fewer, or embedded with up to four more letters."""
    label = F.coalesce(F.try_element_at(F.split(h, r"\."), F.lit(-2)), h)
    for p in ("secure-", "login-", "verify-", "update-", "official-", "my", "the"):
        label = F.regexp_replace(label, f"^{p}", "")
    for s in ("-secure", "-login", "-verify", "-update", "-official", "-support", "-help", "-india"):
        label = F.regexp_replace(label, f"{s}$", "")
    near = lambda n, b: ((F.length(b) >= 4) & (F.levenshtein(n, b) <= 2)) | (n.contains(b) & (F.length(n) - F.length(b) <= 4))
    names = F.array(*[F.lit(b) for b in brands])
    return let(label, lambda n: F.coalesce(F.try_element_at(F.filter(names, lambda b: (n != b) & near(n, b)), F.lit(1)), F.lit("")))


def trust(url: Column) -> Column:
    """Score of a URL's domain, 0 to 100."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))

    def score(h: Column) -> Column:
        listed = any_of((h == t) | h.endswith("." + t) for t in TRUSTED)
        out = F.lit(60) + F.when(listed, 30).otherwise(0) + F.when(full.startswith("https://"), 5).otherwise(-15)
        out += F.when(tld_risk(h) == "high", -25).when(tld_risk(h) == "medium", -10).otherwise(0)
        out += let(depth(h), lambda d: F.when(d >= 3, -20).when(d >= 2, -8).otherwise(0))
        out += F.when(~listed & (typosquat(h) != ""), -30).otherwise(0) + F.when(h.rlike(r"^\d+\.\d+\.\d+\.\d+$"), -20).otherwise(0) + F.when(F.length(h) > 40, -5).otherwise(0)
        return F.when(h == "", 20).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), out)))

    return F.when(F.coalesce(url, F.lit("")) == "", 50).otherwise(let(host(full), score))


def status_url(url: Column, future: bool = False) -> Column:
    """Handle and time of a post from its URL; the id holds milliseconds since the service's epoch. Ids before that
    scheme, and times beyond next year unless the future is asked for, give null."""
    pattern = r"(?i)(?:twitter|x)\.com/([a-z0-9_]{1,15})/status(?:es)?/([0-9]+)"
    post = F.regexp_extract(url, pattern, 2).try_cast("long")
    at = F.timestamp_millis(F.shiftright(post, 22) + 1288834974657)  # fixed value: the service's epoch
    sound = (post >= 29_000_000_000) & (F.lit(future) | (F.year(at) <= F.year(F.current_date()) + 1))
    return F.when(sound, F.struct(F.lower(F.regexp_extract(url, pattern, 1)).alias("handle"), at.alias("at")))


def qr_kind(value: Column) -> Column:
    """What a code's value is: payment (an address to pay to), link, or text."""
    kind = parts(value)["kind"]
    return F.when(kind == "payment", "payment").when(kind == "web", "link").otherwise("text")


def redirect_chain(hops: Column) -> Column:
    """Number of hops, whether one leaves https, and whether the site changes, of an array of URLs."""
    steps = F.zip_with(hops, F.slice(hops, 2, F.size(hops)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    real = F.filter(steps, lambda s: s["b"].isNotNull())
    return F.struct(F.size(real).alias("hops"), F.exists(real, lambda s: s["a"].startswith("https://") & s["b"].startswith("http://")).alias("downgrade"), F.exists(real, lambda s: registrable(host(s["a"])) != registrable(host(s["b"]))).alias("leaves_site"))




@F.pandas_udf(T.StringType())
def unicode_host(h: pd.Series) -> pd.Series:
    """Host with its encoded labels (xn--) decoded; a label that isn't valid stays as it is."""

    def label(x: str) -> str:
        try:
            return x[4:].encode("ascii").decode("punycode") if x.startswith("xn--") and " " not in x else x
        except (UnicodeError, ValueError):
            return x

    return h.map(lambda x: None if x is None else ".".join(map(label, x.lower().split("."))))


def registrable_parts(h: Column, rules=SUFFIX_RULES) -> Column:
    """domain (suffix and one label), suffix, sld and the subdomains before it, of a host; domain and sld empty for a bare suffix."""
    low = F.rtrim(F.lower(h), F.lit("."))

    def parts(suffix: Column) -> Column:
        before = F.when(low == suffix, "").otherwise(F.substring(low, F.lit(1), F.length(low) - F.length(suffix) - 1))
        sld = F.substring_index(before, ".", -1)
        rest = F.when(F.contains(before, F.lit(".")), F.substring(before, F.lit(1), F.length(before) - F.length(sld) - 1)).otherwise("")
        return F.struct(F.when(sld != "", F.concat(sld, F.lit("."), suffix)).otherwise("").alias("domain"), suffix.alias("suffix"), sld.alias("sld"), rest.alias("subdomains"))

    return let(public_suffix(low, rules), parts)
