"""Dashboards, listings and small comparisons over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiers(rows: DataFrame, public: list[str], anchored: list[str]) -> DataFrame:
    """What may leave: public columns as they are, anchored ones as digests only, and nothing else."""
    return rows.select(*public, *[F.sha2(F.col(c).cast("string"), 256).alias(f"{c}_anchor") for c in anchored])


def counts_since(rows: DataFrame, key: str, time: str, since: Column) -> DataFrame:
    return rows.filter(F.col(time) >= since).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The keys with most rows (ties: the least key)."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(most)


def means(rows: DataFrame, key: str, value: str, digits: int = 1) -> DataFrame:
    return rows.groupBy(key).agg(F.round(F.avg(value), digits).alias("mean"))


def rollup_of_newest(rows: DataFrame, time: str, id: str, most: int, days: int, **groups: Column) -> DataFrame:
    """Counts of the newest rows of the last days before the newest one: by each group, and in all."""
    x = rows.orderBy(F.desc(time), F.desc(id)).limit(most)
    x = x.join(x.agg((F.max(time) - F.expr(f"interval {days} days")).alias("_since")), F.col(time) >= F.col("_since"))  # one row
    x = x.withColumns(groups)
    return x.groupingSets([*[[F.col(g)] for g in groups], []], *[F.col(g) for g in groups]).agg(F.count(F.lit(1)).alias("n"))


def corpus_status(rows: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """Rows of each source, the day of its newest, and whether that lies so many days behind the newest of all."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("_m"))
    whole = per.agg(F.max("_m").alias("_last"))  # one row
    return per.crossJoin(whole).select(key, "n", F.date_format("_m", "yyyy-MM-dd").alias("as_of"), (F.col("_m") < F.col("_last") - F.expr(f"interval {days} days")).alias("stale"))


def greatest_of(rows: DataFrame, key: str, value: Column, id: Column, name: str) -> DataFrame:
    """The greatest value of each key and whose it is (ties: the greatest id as given)."""
    return rows.groupBy(key).agg(F.max(value).alias("value"), F.max_by(name, F.struct(value, id)).alias(name))


def percentiles(rows: DataFrame, key: str, value: str, digits: int = 4, **shares: float) -> DataFrame:
    return rows.groupBy(key).agg(*[F.round(F.percentile(value, F.lit(s)), digits).alias(n) for n, s in shares.items()])


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """So many rows of a listing, behind those of the pages before."""
    return rows.orderBy(*order).offset(offset).limit(size)


def listing(rows: DataFrame, source: str, part: str, score: str, least: float, id: str, most: int) -> DataFrame:
    """Rows whose source holds a part, whatever its case, and whose score is high enough: the highest first."""
    return rows.filter(F.col(source).ilike(f"%{part}%") & (F.col(score) >= least)).orderBy(F.desc(score), id).limit(most)


def in_order(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds place, from 1, of each row among those of its key; a key's rows stay rows, however many they are."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def registration_state(claims: DataFrame, number: str, claimant: str, register: DataFrame, listed: str, owner: str, covered: Column) -> DataFrame:
    """Claims with state: valid (the register's owner is the claimant), collision (somebody else is), invalid (not in a
    register that covers it) or unverified (no register covers it)."""
    known = register.select(F.col(listed).alias("_n"), F.col(owner).alias("_o")).dropDuplicates(["_n"])
    both = claims.join(known, F.col(number) == F.col("_n"), "left")
    missing = F.when(covered, "invalid").otherwise("unverified")
    return both.withColumn("state", F.when(F.col("_n").isNull(), missing).when(F.col(claimant).eqNullSafe(F.col("_o")), "valid").otherwise("collision")).drop("_n", "_o")


def divergence(shown: Column, hidden: Column) -> Column:
    """How many of two lists' members are in both, and how many of the second the first lacks."""
    return F.struct(F.size(F.array_intersect(shown, hidden)).alias("both"), F.size(F.array_except(hidden, shown)).alias("missing"))


def postdates(rows: DataFrame, date: str, corpus: DataFrame, dated: str, days: int) -> DataFrame:
    """Rows dated later than so many days before the newest row of a corpus."""
    edge = corpus.agg((F.max(dated) - F.expr(f"interval {days} days")).alias("_edge"))  # one row
    return rows.join(edge, F.col(date) > F.col("_edge")).drop("_edge")


def within_years(date: Column, first: int, last: int) -> Column:
    return F.year(date).between(first, last)


def conversation_counts(turns: DataFrame, key: str, body: str) -> DataFrame:
    """Lines, numbers and turns of each conversation; a null text has none."""
    lines, numbers = F.size(F.split(F.col(body), "\n")), F.regexp_count(F.col(body), F.lit("[0-9]+"))
    return turns.groupBy(key).agg(F.sum(F.when(F.col(body).isNotNull(), lines)).alias("lines"), F.sum(numbers).alias("numbers"), F.count(F.lit(1)).alias("turns"))


def sensitive_fields(names: Column, kinds: str = "otp|pin|password") -> Column:
    """How many of a form's fields ask for something that nobody should send."""
    return F.size(F.filter(names, lambda f: F.coalesce(F.lower(f).rlike(kinds), F.lit(False))))


def channel_trust(messages: DataFrame, chat: str, sender: str, body: str, least: int = 4, posters: int = 2) -> DataFrame:
    """few_posters (many messages, written by few) and links (some message holds one) of each chat."""
    return messages.groupBy(chat).agg(((F.count(F.lit(1)) >= least) & (F.count_distinct(sender) <= posters)).alias("few_posters"), F.coalesce(F.bool_or(F.col(body).contains("http")), F.lit(False)).alias("links"))


def same_amount(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Whether two amounts agree; null where one isn't stated."""
    return F.abs(a - b) <= tolerance


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts agree but for case and blanks."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return plain(a) == plain(b)


def tolerant(json: Column, path: str, kind: str) -> Column:
    """A field of JSON text; null where the text isn't JSON, lacks the field, or holds something else."""
    return F.get_json_object(json, path).try_cast(kind)


def cube_means(rows: DataFrame, value: str, digits: int, **groups: Column) -> DataFrame:
    """Means by every combination of the groups; what is left out is null."""
    return rows.withColumns(groups).cube(*groups).agg(F.round(F.avg(value), digits).alias("mean"))


def newest_of(rows: DataFrame, test: str, time: str, id: str, most: int) -> DataFrame:
    return rows.filter(test).orderBy(F.desc(time), id).limit(most)


def checks_header(rows: DataFrame, key: str, check: str, passed: Column) -> DataFrame:
    """The header line of each message's checks: `name=pass;name=fail`, each once, sorted."""
    said = F.concat(check, F.lit("="), F.when(passed, "pass").otherwise("fail"))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(said)), ";").alias("header"))
