"""Normalisation of texts, names, hosts and identifiers, as Column functions."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, with the letters they look like.
LOOKALIKES = {
    "а": "a", "А": "A", "е": "e", "Е": "E", "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "у": "y", "У": "Y",
    "х": "x", "Х": "X", "і": "i", "І": "I", "ј": "j", "Ј": "J", "һ": "h", "Н": "H", "В": "B", "М": "M", "К": "K", "Т": "T",
    "Ѕ": "S", "ѕ": "s", "ο": "o", "Ο": "O", "α": "a", "Α": "A", "ε": "e", "Ε": "E", "ρ": "p", "Ρ": "P", "υ": "u", "Υ": "Y",
    "κ": "k", "Κ": "K", "ν": "v", "Ν": "N", "τ": "t", "Τ": "T", "Β": "B", "Η": "H", "Ι": "I", "Μ": "M", "Χ": "X", "ａ": "a", "ｅ": "e", "ｏ": "o",
}
# Code points that are not seen: zero-width, joiners, direction marks, soft hyphen, byte order mark.
INVISIBLE = (0x00AD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF)
# Legal forms and qualifiers at the end of a company's name, longest first.
LEGAL_FORMS = ("private limited", "public limited", "pvt ltd", "pvt. ltd.", "pvt limited", "limited", "ltd", "ltd.", "llp", "inc", "incorporated", "plc", "india", "of india", "(india)")

HIDDEN = "[" + "".join(map(chr, INVISIBLE)) + "]"
WIDE = ("".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F))))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, HIDDEN, "")


def fold_lookalikes(c: Column) -> Column:
    return F.translate(c, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def fold_wide(c: Column) -> Column:
    return F.translate(c, *WIDE)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(T.StringType())
def _compatible(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _decomposed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.combining(x)))


def _settled(form: str, blocks: tuple[range, ...]) -> str:
    """A pattern of characters outside of those in some blocks that a form leaves as they are, whatever stands beside them."""
    kept = [k for b in blocks for k in b if unicodedata.is_normalized(form, chr(k)) and unicodedata.category(chr(k))[0] in "LNPSZ"]
    spans, start = [], None
    for k in kept:
        if start is None or k != last + 1:
            if start is not None:
                spans.append((start, last))
            start = k
        last = k
    spans.append((start, last))
    return "[^\\x00-\\x7F" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


#: What NFKC may change: anything but ASCII and the letters and marks of these blocks that have no other form.
CHANGED = _settled("NFKC", (range(0x80, 0x250), range(0x370, 0x530), range(0x2010, 0x2030), range(0x4E00, 0xA000)))


def compatible(c: Column) -> Column:
    """NFKC; the expression library has none, so texts that it may change go through one Arrow function. Others reach it
    as nulls: Spark evaluates such functions for every row, before it looks at conditions."""
    return F.coalesce(_compatible(F.when(c.rlike(CHANGED), c)), c)


def strip_marks(c: Column) -> Column:
    return F.coalesce(_decomposed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def for_matching(c: Column, lower: bool = True) -> Column:
    """Compatibility form without hidden characters, lookalikes folded, blanks collapsed."""
    out = collapse(fold_lookalikes(strip_invisible(compatible(c))))
    return F.coalesce(F.lower(out) if lower else out, F.lit(""))


def company_name(c: Column) -> Column:
    """Comparable form of a company's name: legal forms and qualifiers at the end go, as often as they stand there."""
    out = F.regexp_replace(for_matching(c), "&", " and ")
    out = collapse(F.regexp_replace(out, r"(?U)[^\w\s@.\-/%:+]", " "))
    ends = "|".join(x.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for x in LEGAL_FORMS)
    return F.trim(F.regexp_replace(out, f"(?: (?:{ends}))+$", ""))


def domain(c: Column) -> Column:
    """Host of a URL or a bare domain: no scheme, path, user, port, last dots or leading www."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.\-]*://", "")
    d = F.regexp_extract(d, r"^[^/?#]*", 0)
    d = F.regexp_replace(d, r"^.*@", "")
    d = F.rtrim(F.regexp_extract(d, r"^[^:]*", 0), F.lit("."))
    return F.coalesce(F.regexp_replace(d, r"^www\.", ""), F.lit(""))


def hash_text(c: Column) -> Column:
    """What is hashed for exact matches: word characters of the comparable form."""
    return F.regexp_replace(for_matching(c), r"(?U)[^\w]", "")


def identity_host(c: Column) -> Column:
    """Host for identity: hidden characters go, stops of other scripts become dots; lookalikes are NOT folded."""
    out = F.lower(compatible(strip_invisible(c)))
    out = F.regexp_replace(F.translate(out, "․。．｡", "...."), r"\.+", ".")
    return F.regexp_replace(F.trim(out), r"^\.|\.\z", "")


def resemblance_host(c: Column) -> Column:
    """Host for resemblance: identity form with lookalikes folded and marks dropped."""
    return F.regexp_replace(F.lower(strip_marks(fold_lookalikes(fold_wide(identity_host(c))))), r"[^a-z0-9.]", "")


def obfuscation(c: Column) -> Column:
    """Counts of hidden characters, lookalikes and full-width forms, and whether Latin is mixed with them."""
    alike = "[" + "".join(LOOKALIKES) + "]"
    hidden, looks, wide = F.regexp_count(c, F.lit(HIDDEN)), F.regexp_count(c, F.lit(alike)), F.regexp_count(c, F.lit("[！-～]"))
    mixed = c.rlike("[A-Za-z]") & c.rlike("[Ͱ-ϿЀ-ӿ]")
    return F.struct(hidden.alias("hidden"), looks.alias("lookalikes"), wide.alias("wide"), mixed.alias("mixed"))


def reference(c: Column) -> Column:
    return F.trim(F.upper(F.regexp_replace(c, r"\s+", "")), F.lit("/"))


def notice_hash(c: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), 256)


def register_name(c: Column) -> Column:
    """Name without corporate words and marks."""
    words = r"\b(private|pvt|public|limited|ltd|llp|inc|plc|company|co|corporation|corp)\b"
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), words, " "), "[^a-z0-9]+", " "), " +", " "))


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def phone10(c: Column) -> Column:
    return F.right(F.regexp_replace(c, r"\D", ""), F.lit(10))


def keyed_digest(c: Column, salt: bytes) -> Column:
    """HMAC-SHA256 of a string under a salt, 128 bits of it, from two hashes with the key's fixed blocks before them."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\x00")
    inner, outer = bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters, hexadecimal."""
    step = lambda h, ch: ((h.bitwiseXOR(F.ascii(ch).cast("long"))) * F.lit(16777619)) % F.lit(1 << 32)
    return F.lower(F.lpad(F.hex(F.aggregate(F.split(c, ""), F.lit(0x811C9DC5).cast("long"), step)), 8, "0"))


def campaign_id(entities: Column) -> Column:
    """Name of a campaign from its entities, each `type:value`."""
    return F.concat(F.lit("cmp_"), F.substring(F.sha2(F.array_join(F.array_sort(entities), "|"), 256), 1, 16))


def message_id(raw: Column, host: str) -> Column:
    return F.concat(F.substring(F.sha2(raw, 256), 1, 32), F.lit(f"@{host}"))


def letter_skeleton(c: Column) -> Column:
    """Letters of a domain with lookalike groups and digits read as letters."""
    out = fold_lookalikes(F.lower(c))
    out = F.regexp_replace(F.regexp_replace(out, "rn", "m"), "vv", "w")
    return F.regexp_replace(F.translate(out, "015", "ols"), "[^a-z]", "")


def registry_skeleton(c: Column) -> Column:
    return F.translate(F.lower(c), "0153@$-.", "olseas")


def registry_domain(c: Column) -> Column:
    """Host of an e-mail address, a URL or a bare domain."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]*)", 1), r"^www\.", "")


def joined(caption: Column, transcript: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n\n", blank(caption), blank(transcript))


def redact(c: Column) -> Column:
    """Telephone numbers and e-mail addresses out, payment addresses (no dot behind the at sign) left."""
    out = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]")
    return F.regexp_replace(out, r"\+?[0-9][0-9 ()-]{8,}[0-9]", "[phone]")


def host_suffixes(host: Column) -> Column:
    """A host and all its parents, longest first."""
    n = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def bare(c: Column) -> Column:
    """The comparable form without blanks, dots, dashes and underscores."""
    return F.regexp_replace(for_matching(c), r"[\s._\-]+", "")
