"""Features of URLs and pages as columns, and models that score every row without having seen its group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import markup, urls
from veriloom.operators import models
from veriloom.sources.shared import shared_dir

# Top-level domains of poor repute, names of brands, words and patterns that features count.
POOR_TLDS = tuple("""tk ml ga cf gq top xyz buzz click link work loan download review country stream gdn racing win bid party trade date faith science
cricket accountant men rest fit surf monster quest cyou icu sbs""".split())
BRANDS = tuple("""paytm phonepe gpay googlepay bhim upi npci sbi hdfc icici axis kotak yesbank pnb bob canara zerodha groww upstox angelone angelbroking
sharekhan motilal iifl 5paisa dhan kite smallcase nse bse sebi nsdl cdsl cams kfintech amfi aadhaar uidai incometax gst epfo irctc amazon flipkart
netflix whatsapp instagram facebook google microsoft apple paypal""".split())
SENSITIVE = ("login", "verify", "otp", "password", "kyc", "aadhaar", "pan", "cvv", "upi", "bank", "account", "wallet", "secure", "update", "confirm")
SECURITIES = ("sebi", "nse", "bse", "demat", "ipo", "trading", "portfolio", "mutual fund", "stock", "shares", "broker", "investment", "returns", "profit", "advisory", "research analyst", "fpi", "block trade", "allotment", "securities")
PROMISE = r"(?i)\b(assured|guaranteed|risk[\s-]?free|100%\s*safe)\b.{0,30}\b(return|returns|profit|gain|income)\b|\b(return|returns|profit)\b.{0,20}\b(guaranteed|assured|risk[\s-]?free)\b"
HANDLE = r"(?i)\b[a-z0-9._-]{2,}@[a-z][a-z0-9.]{1,}\b"
CLAIM = r"(?i)\bIN[AHZPM]\d{6,}\b|\bARN-\d{4,}\b"
VOID = ("br", "img", "input", "meta", "link", "hr", "area", "base")
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"

_RAW = r"(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)\s*>"
_TAG = r"(?s)</?[A-Za-z][^>]*>"
_SPLIT = r"(?s)<!--.*?-->|<![^>]*>|</?[A-Za-z][^>]*>"


def _count(text: Column, part: str) -> Column:
    """How often a string stands in another, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _number(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, stripped; empty if it isn't there."""
    p = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, p, i) for i in (1, 2, 3)]))


def host_group(h: Column) -> dict[str, Column]:
    """Features of a host without `www.`: whole, or of the label before its registrable suffix."""
    reg = urls.without_www(h)
    labels = F.filter(F.split(reg, r"\."), lambda x: x != "")
    address = reg.rlike(IPV4)
    label = F.when(address, "").otherwise(F.regexp_extract(urls.plain_registrable(h), r"^[^.]*", 0))
    tld = F.when(address, "").otherwise(F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")))
    letters, digits = F.length(F.regexp_replace(reg, "[^A-Za-z]", "")), F.length(F.regexp_replace(reg, "[^0-9]", ""))
    runs = F.transform(F.regexp_extract_all(label, F.lit("[b-df-hj-np-tv-z]+"), F.lit(0)), F.length)
    return {
        "host_len": F.length(reg), "host_entropy": urls.entropy(reg), "label_count": F.size(labels), "hyphens": _count(reg, "-"), "digits": digits, "digit_ratio": _ratio(digits, F.length(reg)),
        "vowel_ratio": _ratio(F.length(F.regexp_replace(reg, "[^aeiou]", "")), letters), "longest_label": F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)), "tld_len": F.length(tld),
        "suspicious_tld": _number(tld.isin(*POOR_TLDS)), "has_ip": _number(address), "brand_token_count": sum((reg.contains(b).cast("int") for b in BRANDS), F.lit(0)),
        "domain_entropy": urls.entropy(label), "domain_len": F.length(label), "repeated_char_runs": F.regexp_count(reg, F.lit(r"(.)\1\1+")), "consonant_run_max": F.coalesce(F.array_max(runs), F.lit(0)),
        "has_digit_letter_mix": _number(label.rlike("[0-9]") & label.rlike("[A-Za-z]")),
    }


def dom_group(html: Column, host: Column) -> dict[str, Column]:
    """Features of a page's elements. What stands in scripts and styles are no elements."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", "<!>"), r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")
    tags = F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    starts = lambda *n: F.filter(tags, lambda t: ~t.startswith("</") & name(t).isin(*n))
    outside = lambda u: F.exists(F.array(urls.host(u)), lambda x: u.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//") & (x != "") & ~x.contains(host) & ~host.contains(x))
    either = lambda t: F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "href"))
    links, forms, frames, inputs = starts("a"), starts("form"), starts("iframe"), starts("input")
    loaded = F.filter(starts("img", "link", "source"), lambda t: either(t) != "")
    empty = lambda t: attribute(t, "href").isin("", "#", "javascript:void(0)")
    hidden = lambda t: t.rlike(r"(?i)\shidden(?:[\s=/>]|$)") | F.lower(attribute(t, "style")).contains("display:none") | attribute(t, "width").isin("0", "1")
    # a level deeper at each start, one up at each end, never below none
    moves = F.flatten(F.transform(tags, lambda t: F.when(name(t).isin(*VOID), F.array().cast("array<int>")).when(t.startswith("</"), F.array(F.lit(-1))).when(t.endswith("/>"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, m: F.struct(F.greatest(s["now"] + m, F.lit(0)).alias("now"), F.greatest(s["most"], s["now"] + m).alias("most"))
    pieces = F.concat(F.split(bare, _SPLIT), F.regexp_extract_all(html, F.lit(_RAW), F.lit(1)))
    chars = F.aggregate(pieces, F.lit(0), lambda s, p: s + F.length(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), "&(?:#[0-9]+|[A-Za-z]+);", ".")))
    n = lambda a: F.size(a)
    return {
        "external_link_ratio": F.round(n(F.filter(links, lambda t: ~empty(t) & outside(attribute(t, "href")))) / F.greatest(n(links), F.lit(1)), 4), "empty_links_ratio": F.round(n(F.filter(links, empty)) / F.greatest(n(links), F.lit(1)), 4),
        "suspicious_form_action": _number(F.exists(forms, lambda t: (attribute(t, "action") != "") & outside(attribute(t, "action")))), "hidden_iframe_count": n(F.filter(frames, hidden)),
        "script_to_content_ratio": F.round(n(starts("script")) / F.greatest(F.floor(chars / 40), F.lit(1)), 4), "password_field_count": n(F.filter(inputs, lambda t: F.lower(attribute(t, "type")) == "password")), "input_field_count": n(inputs),
        "meta_refresh_present": _number(F.exists(starts("meta"), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")), "external_resource_ratio": F.round(n(F.filter(loaded, lambda t: outside(either(t)))) / F.greatest(n(loaded), F.lit(1)), 4),
        "dom_nesting_depth": F.aggregate(moves, begin, step, lambda s: s["most"]),
    }


def lexical_group(url: Column, text: Column, host: Column) -> dict[str, Column]:
    low = lambda k: F.lower(url).contains(k) | F.lower(text).contains(k)
    return {
        "url_length": F.length(url), "url_entropy": F.round(urls.entropy(url), 4), "subdomain_count": F.greatest(_count(host, ".") - 1, F.lit(0.0)), "param_count": _count(urls.parts(url)["query"], "="),
        "has_ip_host": _number(host.rlike(IPV4)), "has_punycode": _number(host.contains("xn--")), "sensitive_keyword_count": sum((low(k).cast("int") for k in SENSITIVE), F.lit(0)),
    }


def securities_group(url: Column, text: Column, resolves: Column, distance: Column) -> dict[str, Column]:
    low = F.lower(F.concat(url, F.lit("\n"), text))
    found = F.concat(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(0)), F.regexp_extract_all(url, F.lit(HANDLE), F.lit(0)))
    hits = sum((_count(low, k) for k in SECURITIES), F.lit(0.0))
    return {
        "upi_id_present": _number(F.size(found) > 0), "upi_outside_valid_namespace": _number((F.size(found) > 0) & ~F.exists(found, lambda u: F.lower(u).contains("@valid"))), "registration_claim_present": _number(text.rlike(CLAIM)),
        "registration_resolves": _number(resolves), "securities_keyword_density": F.round(hits / F.greatest(F.regexp_count(low, F.lit("[a-z0-9]+")), F.lit(1)), 4), "typosquat_distance_to_intermediary": F.coalesce(distance, F.lit(99)), "guaranteed_return_claim_present": _number(low.rlike(PROMISE)),
    }


def extract(pages: DataFrame, url: str = "url", html: str = "html", resolves: Column | None = None, distance: Column | None = None) -> DataFrame:
    """Pages with 41 features of their URL, elements, text and host; null URLs and pages count as empty.

    resolves: whether the page's registration was found in a register; distance: letters between the host and the next
    registered name; without them, not found and far.
    """
    rows = pages.withColumns({"_url": F.coalesce(F.col(url), F.lit("")), "_html": F.coalesce(F.col(html), F.lit(""))}).withColumns({"_host": urls.host(F.col("_url")), "_text": markup.plain_text(F.col("_html"))})
    u, t, h = F.col("_url"), F.col("_text"), F.col("_host")
    groups = lexical_group(u, t, h) | dom_group(F.col("_html"), h) | securities_group(u, t, F.lit(False) if resolves is None else resolves, F.lit(None).cast("int") if distance is None else distance) | host_group(h)
    return rows.withColumns({k: v.cast("double") for k, v in groups.items()}).drop("_url", "_html", "_host", "_text")


def artefacts(url: Column) -> dict[str, Column]:
    """34 features that tell how a corpus of URLs was collected rather than what they are."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    p, host = urls.parts(whole), urls.host(whole)
    path, query = p["path"], p["query"]
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    kept = lambda keep: F.length(F.regexp_replace(url, f"[^{keep}]", ""))
    digits, letters = kept(r"\p{Nd}"), kept(r"\p{L}")
    words = F.filter(F.split(url, "[^A-Za-z0-9]+"), lambda x: x != "")
    return {
        "url_len": F.length(url), "host_len": F.length(host), "path_len": F.length(path), "query_len": F.length(query), "n_dots": _count(url, "."), "n_slashes": _count(url, "/"), "n_hyphens": _count(url, "-"), "n_digits": digits, "digit_ratio": _ratio(digits, F.length(url)),
        "n_params": _count(query, "="), "n_amps": _count(query, "&"), "is_https": _number(p["scheme"] == "https"), "has_www": _number(host.startswith("www.")), "has_port": _number(p["port"].try_cast("int") > 0), "n_subdomains": F.greatest(F.size(labels) - 2, F.lit(0)),
        "tld_len": F.length(F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))), "url_entropy": urls.entropy(url), "host_entropy": urls.entropy(host), "path_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "has_query": _number(query != ""), "has_fragment": _number(p["fragment"] != ""),
        "n_upper": kept(r"\p{Lu}"), "n_special": F.length(url) - kept(r"\p{L}\p{N}"), "longest_token": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)), "has_ip": _number(host.rlike(IPV4)), "has_punycode": _number(host.contains("xn--")), "n_at": _count(url, "@"), "n_equals": _count(url, "="),
        "n_underscore": _count(url, "_"), "n_percent": _count(url, "%"), "path_has_ext": _number(path.rlike(r"(?i)\.(php|html?|aspx?|jsp)$")), "n_letters": letters, "vowel_ratio": _ratio(kept("aeiouAEIOU"), letters), "bare_homepage": _number(F.trim(path, F.lit("/")) == ""),
    }


def with_artefacts(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumns({k: v.cast("double") for k, v in artefacts(F.coalesce(F.col(url), F.lit(""))).items()})


def out_of_fold(rows: DataFrame, names: list[str], label: str, group: Column, k: int = 5) -> DataFrame:
    """Rows with fold and p, their probability under the model of the folds that they aren't in.

    All rows of a group are in one fold, so that no group is scored by a model that has seen it. A fold whose training
    rows are of one class gives that class's share. The features are written once; each model reads them once.
    """
    path = f"{shared_dir(rows.sparkSession)}/folds-{uuid.uuid4().hex}"
    models.folds(rows, group, k).write.partitionBy("fold").parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    out = None
    for i in range(k):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        classes, share = train.agg(F.count_distinct(label), F.avg(label)).first()
        part = models.score(test, models.fit(train, names, label), names).drop("weight") if classes > 1 else test.withColumn("p", F.lit(share or 0.0))
        out = part.select(*rows.columns, "p") if out is None else out.unionByName(part.select(*rows.columns, "p"))
    return out


def pooled(scored: DataFrame, label: str, rate: float = 0.01) -> DataFrame:
    """One row: n, mcc at 0.5, average precision, recall at a false positive rate and Brier score of pooled scores."""
    from veriloom.operators.scoring import mcc

    hit, y = F.col("p") >= 0.5, F.col(label) == 1
    cells = scored.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(a & b).alias(c) for a, b, c in ((hit, y, "tp"), (hit, ~y, "fp"), (~hit, y, "fn"), (~hit, ~y, "tn"))])
    return cells.select("n", mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).alias("mcc")).crossJoin(models.measures(scored, "p", label, rate))  # both are one row
