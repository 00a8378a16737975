"""Rollups, top-k, dedup, retention and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(rows: DataFrame, key: str, time: str, verdict: str, carry: str, least: int = 2) -> DataFrame:
    """Groups of rows with one key: count, first and last time, greatest verdict, the value carried by the first row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max(verdict).alias("verdict"), F.min_by(carry, F.struct(time, carry)).alias(carry)).filter(F.col("n") >= least)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new ones whose key isn't there; of new rows with one key the first by all columns; blank keys count as none and always go in."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    fresh = new.filter(~blank).join(old.select(key), key, "left_anti").select(*old.columns)
    one = latest(fresh, [key], [F.col(c) for c in fresh.columns])
    return old.unionByName(one).unionByName(new.filter(blank).select(*old.columns))


def update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the columns of the new row of their key, where there is one and it states them.

    Of several new rows with one key, the least by the columns counts; old rows are never multiplied.
    """
    n = latest(new, [key], [F.col(c).asc_nulls_last() for c in columns]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = old.join(n, F.col(key) == F.col("_k"), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def retain(rows: DataFrame, time: str, key: str, now: Column, days: int = 90, most: int = 500) -> DataFrame:
    """Rows younger than so many days, and of these the newest by key."""
    return rows.filter(F.col(time) >= now - F.expr(f"interval {days} days")).orderBy(F.col(key).desc()).limit(most)


def confusion(rows: DataFrame, expected: str, got: str, classes: list) -> DataFrame:
    """tp, fp, fn of each class in one pass."""
    cells = rows.groupBy(expected, got).agg(F.count(F.lit(1)).alias("n"))
    each = cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    hit, said = F.col(expected) == F.col("class"), F.col(got) == F.col("class")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("class").agg(total(hit & said).alias("tp"), total(~hit & said).alias("fp"), total(hit & ~said).alias("fn"))


def vote(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value that most rows of a key have (ties: the least), its votes, all votes, and whether it has the majority."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col(value).alias("value"))).alias("b"), F.sum("votes").alias("all_votes"))
    return best.select(key, "b.value", (-F.col("b.less")).alias("votes"), "all_votes", (-2 * F.col("b.less") > F.col("all_votes")).alias("agreed"))


def fact_rows(verdicts: DataFrame, most_urls: int = 5, most_codes: int = 20) -> DataFrame:
    """What is stored of each verdict: the site of the first of its URLs, its codes (the first so many), channel and time."""
    site = F.nullif(F.regexp_extract(F.try_element_at(F.slice("urls", 1, most_urls), F.lit(1)), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1), F.lit(""))
    return verdicts.select("msg_id", "created_at", "channel", "verdict", F.lower(site).alias("top_domain"), F.slice("codes", 1, most_codes).alias("reason_codes"))


def observation_tables(observations: DataFrame) -> dict[str, DataFrame]:
    """An observation with entities and reasons as three tables: facts, one row an entity, one row a reason.

    Of rows with one id the latest counts, with its entities and reasons in place of earlier ones.
    """
    one = latest(observations, ["id"], [F.col("observed_at").desc(), F.col("channel")])
    entity = one.select(F.col("id").alias("observation_id"), F.explode(F.array_distinct("entities")).alias("e")).select("observation_id", F.col("e.type").alias("entity_type"), F.col("e.value").alias("entity_value"))
    reason = one.select(F.col("id").alias("observation_id"), F.posexplode("reasons").alias("place", "code"))
    return {"observations": one.drop("entities", "reasons"), "sightings": entity, "reasons": reason}


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace: rows of `new` (the last of a key by all columns) in place of old ones of their key."""
    one = latest(new, [key], [F.col(c).desc_nulls_last() for c in new.columns if c != key] or [F.col(key)])
    return old.join(one.select(key), key, "left_anti").select(*old.columns).unionByName(one.select(*old.columns))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def shared_templates(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest several keys have: the same text, sent by more than one."""
    often = rows.groupBy(digest).agg(F.count_distinct(key).alias("_n")).filter("_n > 1").select(digest)
    return rows.join(often, digest, "left_semi")
