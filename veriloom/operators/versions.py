"""Versions of a register: digests by key range, differences between versions, and what a version covers on a date.

A version's rows lie in ranges of neighbouring keys. Every range has a digest of its rows, and sixteen neighbours have
a digest of theirs, up to one of the whole version; a change of a row changes the digests above it only. Two versions
are compared from the top: ranges below equal digests are never looked at, and rows are read of ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nodes below one.
FAN = 16
#: So many levels bring 16^12 ranges together.
LEVELS = 12


def merged(harvests: DataFrame, number: str = "number", category: str = "category", order: str = "landed") -> DataFrame:
    """One row a number of harvested rows: the first by order, then category. Rows without a number are left out."""
    rest = [c for c in harvests.columns if c not in (number, order, category)]
    first = F.min(F.struct(order, category, *rest)).alias("x")
    return harvests.filter(F.col(number).isNotNull()).groupBy(number).agg(first).select(number, f"x.{category}", *[f"x.{c}" for c in rest])


def coverage(register: DataFrame, harvests: DataFrame, number: str = "number", category: str = "category", as_on: str = "as_on") -> DataFrame:
    """prefix, category, as_on, harvested and records: of each prefix of a register's numbers, the category of its least
    number, the newest date on which that category was harvested, rows harvested of it, and numbers with the prefix."""
    prefixes = register.withColumn("prefix", F.regexp_extract(F.upper(F.col(number)), "^[A-Z]+", 0)).filter("prefix <> ''")
    prefixes = prefixes.groupBy("prefix").agg(F.min_by(category, number).alias(category), F.count(F.lit(1)).alias("records"))
    dates = harvests.groupBy(category).agg(F.max(as_on).alias(as_on), F.count(F.lit(1)).alias("harvested"))
    return prefixes.join(dates, category).select("prefix", category, as_on, "harvested", "records")


def snapshot(rows: DataFrame, key: str, range_: Column, folder: str, version: int) -> None:
    """Writes a version: rows by range with their digests, and the nodes of all levels (level, node, digest).

    Keys are unique and not null. range_ numbers key ranges (from 0), the same way in every version; a range holds so
    many rows at most that their digests fit in one row.
    """
    spark = rows.sparkSession
    columns = [c for c in sorted(rows.columns) if c != key]
    digest = F.sha2(F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"}), 256)
    path = f"{folder}/version={version}"
    rows.select(F.col(key).alias("key"), digest.alias("digest"), F.struct(*columns).alias("row"), range_.cast("long").alias("range")).repartition("range").sortWithinPartitions("range", "key").write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    found = _rows(spark, folder, version, rows.select(F.col(key).alias("key"), digest.alias("digest"), F.struct(*columns).alias("row")))
    together = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256).alias("digest")
    level = found.groupBy(F.col("range").alias("node")).agg(together("key"))
    level.write.mode("overwrite").parquet(f"{path}/nodes/level=0")
    for k in range(1, LEVELS + 1):
        below = spark.read.schema("node long, digest string").parquet(f"{path}/nodes/level={k - 1}")
        below.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(together("node")).write.mode("overwrite").parquet(f"{path}/nodes/level={k}")
        if below.select(F.max("node")).first()[0] in (None, 0):
            break


def _rows(spark: SparkSession, folder: str, version: int, like: DataFrame | None = None) -> DataFrame:
    """Rows of a version; an empty one has no files to tell its columns, so that they are kept beside them."""
    path = f"{folder}/version={version}"
    if like is not None:
        like.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    kind = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(kind.add("range", "long")).parquet(f"{path}/rows")


def _nodes(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("node long, digest string, level int").parquet(f"{folder}/version={version}/nodes")


def changed_ranges(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    """Ranges whose rows differ, found from the top; levels above the lower tree's top are compared as they are."""
    a, b = _nodes(spark, folder, old), _nodes(spark, folder, new)
    top = min(x.agg(F.max("level")).first()[0] or 0 for x in (a, b))
    open_ = None
    for k in range(top, -1, -1):
        x, y = (n.filter(F.col("level") == k).select("node", F.col("digest").alias(c)) for n, c in ((a, "was"), (b, "now")))
        if open_ is not None:
            inside = lambda n: n.withColumn("up", F.floor(F.col("node") / FAN)).join(open_, "up", "left_semi").drop("up")
            x, y = inside(x), inside(y)
        open_ = x.join(y, "node", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select(F.col("node").alias("up"))
    return open_.select(F.col("up").alias("range"))


def differences(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    """key, change (added, removed or changed), was and now (rows) between two versions; only ranges that differ are read."""
    ranges = changed_ranges(spark, folder, old, new)
    rows = lambda v, r, d: _rows(spark, folder, v).join(ranges, "range", "left_semi").select("key", F.col("row").alias(r), F.col("digest").alias(d))
    both = rows(old, "was", "d").join(rows(new, "now", "e"), "key", "full_outer").filter(~F.col("d").eqNullSafe(F.col("e")))
    change = F.when(F.col("d").isNull(), "added").when(F.col("e").isNull(), "removed").otherwise("changed")
    return both.select("key", change.alias("change"), "was", "now")


def as_of(claims: DataFrame, versions: DataFrame, key: str, date: str, since: str = "since") -> DataFrame:
    """Claims with the columns of the version of their key that was valid on their date: the last one that began by then.

    versions has the key, since (a date, unique for a key) and further columns. Every version is laid into the months
    in which it was valid, and claims meet those of their month only, so that a key with a third of all claims is many
    groups. Claims before the first version, and claims without key or date, have nulls.
    """
    until = F.lead(since).over(Window.partitionBy(key).orderBy(since))  # versions, not claims
    last = claims.agg(F.max(date).alias("last"))
    spans = versions.withColumn("until", until).crossJoin(last)  # one row
    month = lambda c: F.trunc(c, "month")
    end = F.coalesce(F.col("until"), F.date_add(F.greatest(F.col("last"), F.col(since)), 1))
    spans = spans.filter(F.col(since) <= F.col("last")).withColumn("month", F.explode(F.sequence(month(F.col(since)), month(F.date_sub(end, 1)), F.expr("interval 1 month")))).drop("last")
    rest = [c for c in versions.columns if c != key]
    spans = spans.withColumnsRenamed({c: f"v_{c}" for c in (*spans.columns,)})
    valid = (F.col(f"v_{since}") <= F.col(date)) & (F.col("v_until").isNull() | (F.col(date) < F.col("v_until")))
    meets = (F.col(key) == F.col(f"v_{key}")) & (month(F.col(date)) == F.col("v_month")) & valid  # one version at most
    return claims.join(spans, meets, "left").select(*claims.columns, *[F.col(f"v_{c}").alias(c) for c in rest])


def standing(claims: DataFrame, registers: DataFrame) -> DataFrame:
    """Claims (number, since, covered) with state: valid if the register that began on that date has the number, invalid
    if it covers the number's category and hasn't, else unverified: what wasn't harvested accuses nobody."""
    there = registers.select("number", "since").distinct().withColumn("_there", F.lit(True))
    rows = claims.join(there, ["number", "since"], "left")
    state = F.when(F.col("_there"), "valid").when(F.coalesce("covered", F.lit(False)), "invalid").otherwise("unverified")
    return rows.withColumn("state", state).drop("_there")
