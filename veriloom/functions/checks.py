"""Validators and check digits, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_cin(c: Column) -> Column:
    return F.upper(c).rlike("^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$")


def isin_digit(c: Column) -> Column:
    """Check digit of the first eleven characters: letters become two digits, then Luhn from the right."""
    body = F.upper(F.substring(c, 1, 11))
    code = lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch)
    digits = F.reverse(F.split(F.array_join(F.transform(F.split(body, ""), code), ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.when(body.rlike("^[A-Z]{2}[A-Z0-9]{9}$"), F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)))


def valid_isin(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (isin_digit(c) == F.substring(c, 12, 1).try_cast("int")), F.lit(False))


def valid_gstin(c: Column) -> Column:
    return c.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$") & F.coalesce(F.substring(c, 1, 2).try_cast("int").between(1, 38), F.lit(False))


def valid_pan(c: Column) -> Column:
    return c.rlike("^[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]$")


def valid_ifsc(c: Column) -> Column:
    return c.rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def registration_kind(c: Column) -> Column:
    """Kind of a registration by its prefix, the longest first."""
    u = F.upper(c)
    return F.when(u.startswith("INZ"), "BROKER").when(u.startswith("INA"), "ADVISER").when(u.startswith("INH"), "ANALYST").when(u.startswith("INP"), "MANAGER").when(u.startswith("IN"), "OTHER")


def prefix(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.startswith("IN-DP"), "IN-DP").otherwise(F.regexp_extract(u, "^[A-Z]*", 0))


def tail_runs(c: Column) -> Column:
    """Kinds and lengths of the runs of digits, letters and others behind the prefix."""
    runs = F.regexp_extract_all(F.regexp_replace(F.upper(c), "^[A-Z]+", ""), F.lit("[0-9]+|[A-Z]+|[^0-9A-Z]+"), F.lit(0))
    kind = lambda r: F.when(r.rlike("^[0-9]"), "D").when(r.rlike("^[A-Z]"), "A").otherwise("L")
    return F.transform(runs, lambda r: F.concat(kind(r), F.length(r).cast("string")))


def generic_name(c: Column, stop=("the", "and", "of", "bank", "india", "company", "limited", "group")) -> Column:
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*stop))


def inconsistent(passed: Column, severity: Column) -> Column:
    """A check that couldn't be determined must not carry a finding of weight."""
    return passed.isNull() & (severity >= 2)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of equal length, sixteen digits at a time; null if lengths differ."""
    word = lambda c, i: F.conv(F.substring(c, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(a) / 16).cast("int") - 1, F.lit(0)))
    total = F.aggregate(F.transform(words, lambda i: F.bit_count(word(a, i).bitwiseXOR(word(b, i)))), F.lit(0), lambda x, y: x + y)
    return F.when(F.length(a) == F.length(b), total)


def family(df: DataFrame, column: str) -> DataFrame:
    """Families of registration numbers: prefix, kinds of runs, least and greatest length, and how many."""
    p = df.select(prefix(F.col(column)).alias("prefix"), F.array_join(F.transform(tail_runs(F.col(column)), lambda r: F.substring(r, 1, 1)), "").alias("kinds"), F.length(column).alias("n"))
    return p.groupBy("prefix", "kinds").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("members"))


def family_pattern(df: DataFrame, column: str) -> str:
    """One pattern that all numbers of a register match, from its families (a few rows, whatever the register)."""
    rows = family(df, column).orderBy("prefix", "kinds").collect()
    kinds = {"D": "[0-9]+", "A": "[A-Z]+", "L": "[^0-9A-Z]+"}
    return "^(?:" + "|".join(r["prefix"].replace("-", "\\-") + "".join(kinds[k] for k in r["kinds"]) for r in rows) + ")$"


def uncovered(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows of a register that a pattern doesn't match: must be none."""
    return df.filter(~F.upper(F.col(column)).rlike(pattern))
