"""Entities in texts: payment handles, numbers, dates, amounts, claims, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.text import fold_lookalikes, strip_invisible

# Patterns of identifiers.
URL = r"https?://[^\s\)\]\}<>\"']+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
HANDLE = r"\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,}\b"
MOBILE = r"(?:\+91[-\s]?)?0?([6-9]\d{9})\b"
CIN = r"\b[LUlu][0-9]{5}[A-Za-z]{2}[0-9]{4}[A-Za-z]{3}[0-9]{6}\b"
ISIN = r"\bIN[A-Z0-9]{9}[0-9]\b"
REGISTRATION = r"\bIN[ABDEHIMNPRZ][A-Z]?[0-9]{6,9}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
AADHAAR = r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"
ACCOUNT = r"\b[0-9]{9,18}\b"
APK = r"\bhttps?://\S+\.apk\b"
AMOUNT = r"(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|lakhs?|lac|crore|cr)?"
CIRCULAR = r"(?i)\bcircular\s+no\.?\s*([A-Z0-9/-]{4,})"
RETURN = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:per|a|every)?\s*(day|daily|week|weekly|month|monthly|year|yearly|annum)"
MONTHS = {"day": 1 / 30, "daily": 1 / 30, "week": 7 / 30, "weekly": 7 / 30, "month": 1.0, "monthly": 1.0, "year": 12.0, "yearly": 12.0, "annum": 12.0}
FREE_MAIL = ("gmail", "yahoo", "outlook", "hotmail", "icloud", "protonmail")


def every(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def distinct(c: Column, pattern: str, group: int = 0, most: int | None = None) -> Column:
    out = F.array_distinct(every(c, pattern, group))
    return F.slice(out, 1, most) if most else out


def urls(c: Column) -> Column:
    return every(c, URL)


def emails(c: Column) -> Column:
    return every(c, EMAIL)


def phones(c: Column) -> Column:
    return every(c, MOBILE, 1)


def handles(c: Column) -> Column:
    """Payment handles: what looks like one and doesn't begin an e-mail address, isn't of a mail service."""
    mails = emails(c)
    good = lambda h: ~F.exists(mails, lambda m: m.startswith(h)) & ~F.lower(F.regexp_extract(h, "@(.*)$", 1)).isin(*FREE_MAIL)
    return F.filter(every(c, HANDLE), good)


def contacts(c: Column) -> Column:
    """Bounded lists of all kinds of contacts, as the gate reports them."""
    return F.struct(F.slice(urls(c), 1, 20).alias("urls"), F.slice(phones(c), 1, 10).alias("phones"), F.slice(handles(c), 1, 10).alias("handles"), F.slice(emails(c), 1, 10).alias("emails"), F.slice(every(c, AADHAAR), 1, 5).alias("aadhaar"), F.slice(every(c, PAN), 1, 5).alias("pan"))


def amount(raw: Column, unit: Column) -> Column:
    times = F.when(F.lower(unit) == "k", 1e3).when(F.lower(unit).isin("lakh", "lakhs", "lac"), 1e5).when(F.lower(unit).isin("crore", "cr"), 1e7).otherwise(1.0)
    return F.regexp_replace(raw, ",", "").try_cast("double") * times


def amounts(c: Column) -> Column:
    return F.zip_with(every(c, AMOUNT, 1), every(c, AMOUNT, 2), amount)


def chat_entities(c: Column) -> Column:
    """Entities of a chat message; hidden characters and lookalikes don't hide them."""
    t = fold_lookalikes(strip_invisible(c))
    links = F.array_distinct(F.transform(urls(t), lambda u: F.regexp_replace(u, "[.,;)]+$", "")))
    ids = F.array_distinct(F.transform(F.filter(every(t, HANDLE), lambda h: ~F.exists(links, lambda u: u.contains(h))), F.lower))
    return F.struct(links.alias("urls"), ids.alias("handles"), F.array_distinct(F.transform(every(t, REGISTRATION), F.upper)).alias("registrations"), distinct(t, MOBILE, 1).alias("phones"), distinct(t, IFSC).alias("ifsc"), amounts(t).alias("amounts"), distinct(t, APK).alias("apks"))


def campaign_entities(c: Column) -> Column:
    """Distinct type and value of what ties messages together."""
    tagged = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), F.lower(x).alias("value")))
    hosts = F.transform(urls(c), lambda u: F.regexp_extract(u, r"^https?://(?:www\.)?([^/:?#]+)", 1))
    return F.array_distinct(F.concat(tagged("upi", handles(c)), tagged("phone", phones(c)), tagged("domain", hosts), tagged("handle", every(c, r"(?<![\w@])@([A-Za-z0-9_]{3,30})\b", 1))))


def dividend(c: Column) -> Column:
    """Dividend per share of a text: an amount per share, an amount after the word, or a percentage of the face value."""
    number = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit("")).try_cast("double")
    per_share = number(r"(?i)(?:rs\.?|inr|₹)\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/-)?\s*per\s+(?:equity\s+)?share")
    named = number(r"(?i)dividend\s+(?:of|@)\s*(?:rs\.?|inr|₹)\s*([0-9]+(?:\.[0-9]+)?)")
    share = number(r"(?i)dividend\s+(?:of|@)\s*([0-9]+(?:\.[0-9]+)?)\s*%") * number(r"(?i)face\s+value\s+(?:of\s+)?(?:rs\.?|inr|₹)\s*([0-9]+(?:\.[0-9]+)?)") / 100
    value = F.coalesce(per_share, named, share)
    return F.when((value > 0) & (value <= 10000), value)


def dates(c: Column) -> Column:
    """Dates of a text in ISO, day-first numeric and textual forms, years 1990 to 2100, by form and place."""
    iso = F.transform(every(c, r"\b((?:19|20|21)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2})\b", 1), lambda d: F.try_to_date(d, "yyyy-M-d"))
    numeric = F.transform(every(c, r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:19|20|21)[0-9]{2})\b", 1), lambda d: F.try_to_date(F.regexp_replace(d, "[.-]", "/"), "d/M/yyyy"))
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    textual = F.transform(every(c, rf"\b([0-9]{{1,2}} {month},? (?:19|20|21)[0-9]{{2}})\b", 1), lambda d: F.try_to_date(F.regexp_replace(d, ",", ""), "d MMMM yyyy"))
    return F.filter(F.array_distinct(F.array_compact(F.concat(iso, numeric, textual))), lambda d: F.year(d).between(1990, 2100))


def date_near(c: Column, keyword: str, window: int = 160) -> Column:
    """The first date within so many characters after a keyword, else the last one before it."""
    at = F.locate(keyword, F.lower(c))
    after = F.try_element_at(dates(F.substring(c, at, F.lit(window))), F.lit(1))
    return F.when(at > 0, F.coalesce(after, F.try_element_at(dates(F.substring(c, F.lit(1), at)), F.lit(-1))))


def voting_window(c: Column) -> Column:
    """First two dates in the 600 characters from the word e-voting, in order, if 0 to 45 days apart."""
    seg = F.substring(c, F.locate("e-voting", F.lower(c)), F.lit(600))
    d = dates(seg)
    a, b = F.try_element_at(d, F.lit(1)), F.try_element_at(d, F.lit(2))
    ok = (F.locate("e-voting", F.lower(c)) > 0) & (F.abs(F.datediff(a, b)) <= 45)
    return F.when(ok, F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end")))


def document_type(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("dividend"), "DIVIDEND").when(t.contains("annual general meeting") | t.contains("agm"), "AGM").when(t.contains("e-voting"), "EVOTING").when(t.contains("result"), "RESULTS").otherwise("OTHER")


def trim_handle(h: Column, most: int = 24) -> Column:
    """A handle whose local part ran into the words before it keeps its last run of letters and digits."""
    local = F.regexp_extract(h, "^[^@]*", 0)
    return F.when(F.length(local) > most, F.concat(F.regexp_extract(local, r"[a-zA-Z0-9]+$", 0), F.regexp_extract(h, "@.*$", 0))).otherwise(h)


def registrations(c: Column, lengths=(12, 11, 10)) -> Column:
    found = F.array_distinct(F.transform(every(c, REGISTRATION), F.upper))
    return F.filter(found, lambda r: F.length(r).isin(*lengths))


def registration_shapes(c: Column) -> Column:
    return F.array_union(registrations(c), F.array_distinct(F.transform(every(c, r"(?i)\b(?:ARN-?[0-9]{3,6}|IN-DP-[0-9]{1,4}-[0-9]{4})\b"), F.upper)))


def payment_targets(c: Column) -> Column:
    """Handles, payment links, and an account only together with a bank code."""
    bank = F.when((F.size(every(c, IFSC)) > 0) & (F.size(every(c, ACCOUNT)) > 0), F.array(F.concat(F.lit("bank:"), F.try_element_at(every(c, IFSC), F.lit(1)))))
    return F.concat(handles(c), every(c, r"upi://\S+"), F.coalesce(bank, F.array().cast("array<string>")))


def claims(c: Column) -> Column:
    """Statistics with what stands around them, quotations and attributions, a few of each."""
    return F.struct(F.slice(every(c, r".{0,40}[0-9]+(?:\.[0-9]+)?\s?%.{0,40}"), 1, 5).alias("figures"), F.slice(every(c, r"\"([^\"]{10,200})\"", 1), 1, 5).alias("quotes"), F.slice(every(c, r"(?i)according to ([A-Za-z ]{3,40})", 1), 1, 5).alias("sources"))


def references(c: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(every(c, CIRCULAR, 1), F.upper), every(c, r"\bPR No\.?\s*([0-9]+/[0-9]{4})", 1)))


def cin(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(c, CIN, 0)), F.lit(""))


def entity_kind(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.rlike(r"\b(bank)\b"), "BANK").when(t.rlike(r"\b(broker|securities)\b"), "BROKER").when(t.rlike(r"\b(fund|amc)\b"), "FUND").otherwise("COMPANY")


def return_promises(c: Column) -> Column:
    """Promised percentages with their period in months, and per month."""
    span = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(p))
    return F.zip_with(every(c, RETURN, 1), every(c, RETURN, 2), lambda v, p: F.struct(v.cast("double").alias("percent"), span(p).alias("months"), (v.cast("double") / span(p)).alias("monthly")))


def attachment(c: Column) -> Column:
    """File name and size that a chat row states."""
    p = r"([\w.-]+\.(?:apk|pdf|jpg|png|zip|exe|docx?))\s*(?:[·•(]\s*([0-9.]+\s?[kKmM][bB]))?"
    return F.struct(F.nullif(F.regexp_extract(c, p, 1), F.lit("")).alias("name"), F.nullif(F.regexp_extract(c, p, 2), F.lit("")).alias("size"))


def address_domain(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"@([A-Za-z0-9.-]+)", 1)), F.lit(""))


#: Lines of a quoted header block, as mail programs write them.
QUOTED_FROM = r"(?im)^>?\s*(?:-+\s*(?:forwarded|original) message\s*-+|begin forwarded message:)"


def forwarded(c: Column, attached: Column) -> Column:
    """How a message was forwarded, and the original's sender and subject: ATTACHED (an original is there as such),
    INLINE (a quoted header block with a sender), or DIRECT."""
    sender = F.nullif(F.regexp_extract(c, r"(?im)^>?\s*From:\s*(?:[^<\n]*<)?([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), F.lit(""))
    subject = F.nullif(F.trim(F.regexp_extract(c, r"(?im)^>?\s*Subject:[ \t]*([^\n]*)$", 1)), F.lit(""))
    inline = c.rlike(QUOTED_FROM) & sender.isNotNull()
    kind = F.when(attached, "ATTACHED").when(F.coalesce(inline, F.lit(False)), "INLINE").otherwise("DIRECT")
    return F.struct(kind.alias("kind"), F.when(kind != "DIRECT", F.lower(sender)).alias("sender"), F.when(kind != "DIRECT", subject).alias("subject"))


def fields(c: Column) -> Column:
    """All structured fields of a text; telephone numbers and identifiers of other kinds are no accounts."""
    found = {"isin": distinct(c, ISIN), "cin": distinct(c, CIN), "registrations": distinct(c, REGISTRATION), "handles": F.array_distinct(handles(c)), "ifsc": distinct(c, IFSC), "pan": distinct(c, PAN), "phones": F.array_distinct(phones(c)), "urls": F.array_distinct(urls(c))}
    others = F.concat(found["phones"], F.transform(distinct(c, AADHAAR), lambda x: F.regexp_replace(x, r"\s", "")))
    accounts = F.array_except(distinct(c, ACCOUNT), others)
    return F.struct(dividend(c).alias("dividend"), dates(c).alias("dates"), accounts.alias("accounts"), *[v.alias(k) for k, v in found.items()])
