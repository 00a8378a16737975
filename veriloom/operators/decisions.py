"""Verdicts on URLs as graphs of tests in order of their cost.

Tests that need the URL alone come first. What they settle is united with the rest at the end and meets no join; only
open rows are shuffled, by the key that the next test needs, and with no more than that test needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import urls
from veriloom.operators.scoring import risk_level

#: From best to worst.
VERDICTS = ("safe", "unverified", "suspicious", "dangerous")


def level(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def trusted(h: Column) -> Column:
    return urls.any_of((h == t) | h.endswith("." + t) for t in urls.TRUSTED)


def url_trust(rows: DataFrame, url: str, domains: DataFrame, young: int = 30) -> DataFrame:
    """Rows with trust_score, risk_level, signals and advice of their URL.

    domains has host (each once), age_days (null: unknown) and listed (by a block list). URLs without a host and hosts
    of the trusted list are settled by the URL alone; for others what domains says is taken off the score.
    """
    u, h = F.col(url), F.col("_host")
    squat = F.col("_squat")
    rows = rows.withColumn("_host", urls.host(F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))).withColumns({"_score": urls.trust(u), "_squat": urls.typosquat(F.col("_host"))})
    settled = F.coalesce(u == "", F.lit(True)) | (h == "") | trusted(h)
    there = domains.select(F.col("host").alias("_host"), "age_days", "listed")
    open_ = rows.filter(~settled).join(there, "_host", "left")
    closed = rows.filter(settled).withColumns({"age_days": F.lit(None).cast("int"), "listed": F.lit(None).cast("boolean")})

    def finished(df: DataFrame) -> DataFrame:
        listed, fresh = F.coalesce("listed", F.lit(False)), F.coalesce(F.col("age_days") < young, F.lit(False))
        score = F.greatest(F.lit(0), F.col("_score") - F.when(listed, 40).otherwise(0) - F.when(fresh, 15).otherwise(0)).cast("int")
        plain = ~F.coalesce(u.startswith("https://") | ~u.contains("://"), F.lit(True))
        imitates = F.coalesce((squat != "") & ~trusted(h), F.lit(False))
        tld = F.when(F.coalesce(u, F.lit("")) != "", urls.tld_risk(h))
        codes = F.array_compact(F.array(F.when(listed, "listed"), F.when(fresh, "young"), F.when(plain, "plain_http"), F.when(imitates, "imitates"), F.when(tld.isin("high", "medium"), F.concat(F.lit("tld_"), tld))))
        says = F.array_compact(F.array(F.when(score < 40, "This domain has low trust. Be cautious."), F.when(imitates, F.format_string("This domain may imitate %s. Check the address.", squat)), F.when(plain, "This site doesn't use HTTPS. Enter nothing that is private.")))
        return df.select(*[c for c in rows.columns if not c.startswith("_")], score.alias("trust_score"), risk_level(score).alias("risk_level"), codes.alias("signals"), says.alias("advice"))

    return finished(closed).unionByName(finished(open_))


def link_verdict(url: Column) -> Column:
    """Verdict on a link by the link alone."""
    p, h = urls.parts(url), urls.host(url)
    known = trusted(h)
    return (
        F.when(p["has_user"] | p["is_ip"] | (p["kind"] == "script") | (~known & (urls.typosquat(h) != "")), "dangerous")
        .when(known, "safe").when(p["punycode"] | (urls.tld_risk(h) == "high") | urls.credential_in_url(url), "suspicious")
        .when(p["shortener"] | (urls.tld_risk(h) == "medium") | (p["scheme"] == "http"), "unverified").otherwise("safe")
    )


def preflight_links(links: DataFrame, key: str, url: str, blocked: DataFrame, hops: DataFrame, expand: Column | None = None) -> DataFrame:
    """key, local, verdict, destination and reason of links.

    blocked has host, hops has url and final. A dangerous link is settled, and so is a trusted host that hides nothing.
    Other hosts are looked up among the blocked ones. Links that hide their destination (expand, else the known
    shorteners) are followed by hops unless they hold a token for one use; the destination is judged like a link, and
    the worse verdict stands. reason: settled, looked_up, followed, single_use (not followed), or unknown (no hop).
    """
    u, h = F.col("_url"), F.col("_host")
    hides = urls.parts(F.col(url))["shortener"] if expand is None else expand
    rows = links.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(hides, F.lit(False)).alias("_hides")).withColumns({"_host": urls.host(u), "_local": link_verdict(u)})
    bad = blocked.select(F.col("host").alias("_host")).distinct().withColumn("_bad", F.lit(True))
    settled = (F.col("_local") == "dangerous") | (trusted(h) & ~F.col("_hides"))
    asked = lambda df: df.join(bad, "_host", "left").withColumn("_local2", F.when(F.col("_bad"), "dangerous").otherwise(F.col("_local"))).drop("_bad")
    out = lambda df, verdict, to, reason: df.select(F.col("_key").alias(key), F.col("_local").alias("local"), verdict.alias("verdict"), to.cast("string").alias("destination"), reason.alias("reason"))
    none = F.lit(None)
    closed = out(rows.filter(settled), F.col("_local"), none, F.lit("settled"))
    looked = out(asked(rows.filter(~settled & ~F.col("_hides"))), F.col("_local2"), none, F.lit("looked_up"))
    hidden = rows.filter(~settled & F.col("_hides"))
    once = F.coalesce(urls.single_use_token(u), F.lit(False))
    kept_ = out(asked(hidden.filter(once)), F.col("_local2"), none, F.lit("single_use"))
    ways = hops.select(F.col("url").alias("_url"), F.col("final").alias("_final")).groupBy("_url").agg(F.min("_final").alias("_final"))
    gone = asked(hidden.filter(~once)).join(ways, "_url", "left").withColumns({"_host": urls.host(F.coalesce("_final", F.lit(""))), "_there": link_verdict(F.coalesce("_final", F.lit("")))})
    gone = gone.join(bad, "_host", "left").withColumn("_there", F.when(F.col("_final").isNull(), F.lit(None)).when(F.col("_bad"), "dangerous").otherwise(F.col("_there")))
    worse = F.when(level(F.col("_there")) > level(F.col("_local2")), F.col("_there")).otherwise(F.col("_local2"))
    followed = out(gone, worse, F.col("_final"), F.when(F.col("_final").isNull(), "unknown").otherwise("followed"))
    return closed.unionByName(looked).unionByName(kept_).unionByName(followed)
