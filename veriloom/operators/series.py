"""Ordered analytics: market z-scores, gaps, ladders, dormancy, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.sources.shared import kept


def market_scores(bars: DataFrame, events: DataFrame, window: int = 2, baseline: int = 20, least: int = 5) -> DataFrame:
    """z-scores of volume and return around an event against the bars before it.

    bars has ticker, day, close, volume; events ticker, day. The window is the event's day and so many to either
    side; the baseline the last bars before the window, without it. Fewer than `least` bars give no row.
    """
    by = Window.partitionBy("ticker").orderBy("day")
    b = bars.withColumns({"ret": F.col("close") / F.lag("close").over(by) - 1, "n": F.row_number().over(by)}).select(F.col("ticker").alias("t"), "day", "volume", "ret", "n")
    e = events.select("ticker", F.col("day").alias("at")).distinct()
    # bars are numbered once; an event meets the bars of its days, and the numbers before the first of these
    days = e.withColumn("d", F.explode(F.sequence(F.date_sub("at", window), F.date_add("at", window))))
    near = days.join(b, (F.col("ticker") == F.col("t")) & (F.col("d") == F.col("day"))).select("ticker", "at", "volume", "ret", "n", F.lit(True).alias("inside"))
    first = near.groupBy("ticker", "at").agg(F.min("n").alias("first")).filter("first > 1")
    numbers = first.withColumn("k", F.explode(F.sequence(F.greatest(F.col("first") - baseline, F.lit(1)), F.col("first") - 1)))
    before = numbers.join(b, (F.col("ticker") == F.col("t")) & (F.col("k") == F.col("n"))).select("ticker", "at", "volume", "ret", "n", F.lit(False).alias("inside"))
    used = near.unionByName(before)
    base, win = ~F.col("inside"), F.col("inside")
    got = used.groupBy("ticker", "at").agg(
        F.count_if(base).alias("n_base"), F.count_if(win).alias("n_window"), F.avg(F.when(base, F.col("volume"))).alias("vm"), F.stddev_samp(F.when(base, F.col("volume"))).alias("vs"),
        F.stddev_samp(F.when(base, F.col("ret"))).alias("rs"), F.max(F.when(win, F.col("volume"))).alias("peak"), F.max(F.when(win, F.abs("ret"))).alias("move"),
    )
    z = lambda a, s: F.coalesce(F.when(F.col(s) > 0, a / F.col(s)), F.lit(0.0))
    got = got.filter((F.col("n_base") >= least) & (F.col("n_window") > 0))
    got = got.select("ticker", "at", "n_base", F.round(z(F.col("peak") - F.col("vm"), "vs"), 2).alias("volume_z"), F.round(z(F.coalesce("move", F.lit(0.0)), "rs"), 2).alias("return_z"))
    return got.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.abs("volume_z"), F.abs("return_z")) / 4)))


def gap_uniformity(rows: DataFrame, key: str, time: str, least: int = 6, most: float = 0.35) -> DataFrame:
    """Median gap and coefficient of variation of the gaps of each key with enough stamps."""
    gap = (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(Window.partitionBy(key).orderBy(time))) / 1e6
    got = rows.select(key, gap.alias("g")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile("g", F.lit(0.5)).alias("median"), F.try_divide(F.stddev_pop("g"), F.avg("g")).alias("cv"))
    return got.filter(F.col("n") >= least).withColumn("uniform", F.coalesce(F.col("cv") < most, F.lit(False)))


def escalation(rows: DataFrame, key: str, order: str, amount: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """Keys whose amounts, in order, mostly rise and end higher than they began."""
    w = Window.partitionBy(key).orderBy(order)
    rise = F.col(amount) > F.lag(amount).over(w)
    got = rows.select(key, F.col(order).alias("o"), F.col(amount).alias("v"), rise.alias("rise")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rise")).alias("rises"), F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"))
    return got.filter(F.col("n") >= least).withColumn("escalates", (F.col("rises") >= share * (F.col("n") - 1)) & (F.col("last") > F.col("first")))


def resurfacing(rows: DataFrame, key: str, time: str, days: int = 14) -> DataFrame:
    """Times at which a key came back after so many days."""
    gap = F.datediff(time, F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    return rows.select(key, time, gap.alias("gap_days")).filter(F.col("gap_days") >= days)


def rate(rows: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """How many of a key's rows fall into the span that ends with each row."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("hits", F.count(F.lit(1)).over(w))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds _i, the place of every row in an order, from 0: rows are sorted in ranges, which begin after the rows of those
    before; only the ranges' counts meet in one place."""
    ranges = kept(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranges.withColumn("_i", within).join(starts, "_p").withColumn("_i", F.col("_i") + F.col("_s")).drop("_p", "_s")


def stride(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Every n-th row by an order, so many in all."""
    n = rows.count()
    step = max(n / size, 1.0)
    return numbered(rows, order).filter((F.col("_i") == 0) | (F.floor(F.col("_i") / step) != F.floor((F.col("_i") - 1) / step))).drop("_i")
