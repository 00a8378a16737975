"""Evaluation by injection: known attacks are put among real sightings, and detection is held against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.lookups import time_neighbours


def draw(rows: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """k rows of each stratum (all if fewer), the ones with the least digests of their key: the same rows on every run.

    Ties of a digest go by key; the rows of a stratum are cut down in every task before they meet.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(digest, key))
    return rows.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def injected(victims: DataFrame, number: str, handles: Column, start: Column, gap: Column) -> DataFrame:
    """Sightings (number, handle, ts) of made-up handles: so many for each victim, so many days apart from a start on."""
    each = victims.select(F.col(number).alias("number"), start.alias("start"), gap.alias("gap"), F.explode(F.sequence(F.lit(1), handles)).alias("i"))
    return each.select("number", F.format_string("fake-%s-%d", F.left(F.sha2(F.col("number").cast("string"), 256), F.lit(8)), "i").alias("handle"), F.timestamp_micros(F.unix_micros("start") + (F.col("i") - 1) * F.col("gap") * 86_400_000_000).alias("ts"))


def detect(sightings: DataFrame, owners: DataFrame, days: float = 30) -> DataFrame:
    """Numbers that two handles other than the owner's use within so many days.

    sightings has number, handle, ts; owners number and handle. Two such sightings exist exactly if two that follow one
    another in time differ in their handle.
    """
    strange = sightings.join(owners, ["number", "handle"], "left_anti").select("number", "ts", F.struct("handle", "ts").alias("seen"))
    pairs = time_neighbours(strange.withColumn("seen", F.struct("seen.handle", "number")), ["number"], "ts", "seen", days)
    return pairs.filter(F.col("a.handle") != F.col("b.handle")).select(F.col("a.number").alias("number")).distinct()


def recall(rows: DataFrame, victims: DataFrame, found: DataFrame, number: str, stratum: str) -> DataFrame:
    """Of each stratum of rows (number, stratum): victims, detected, recall, and false alarms (found, but no victims)."""
    flag = lambda df, name: df.select(F.col(number)).distinct().withColumn(name, F.lit(1))
    all_ = rows.select(number, stratum).join(flag(victims, "_v"), number, "left").join(flag(found.select(F.col("number").alias(number)), "_f"), number, "left")
    got = all_.groupBy(stratum).agg(F.count("_v").alias("victims"), F.count_if(F.col("_v").isNotNull() & F.col("_f").isNotNull()).alias("detected"), F.count_if(F.col("_v").isNull() & F.col("_f").isNotNull()).alias("false_alarms"))
    return got.withColumn("recall", F.round(F.try_divide(F.col("detected").cast("double"), F.col("victims")), 6))
