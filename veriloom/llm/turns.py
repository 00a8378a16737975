"""Turns of conversations in order, without bringing a conversation into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose numbers agree in all but the last eight bits are ordered together.
SPAN = 256


def _spanned(turn: Column) -> Column:
    return F.coalesce(F.shiftright(turn.cast("long"), 8), F.lit(-(1 << 62)))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds pos, the place from 0 of a row among those of its key (never null), by turn (nulls first), role and text.

    A key's rows are ordered in spans of SPAN turn numbers, each of which starts after the rows of the spans before
    it, so that a key with a third of all rows is many groups. Rows of equal turn, role and text are the same to any
    reader; they get places in some order.
    """
    rows = rows.withColumn("span", _spanned(F.col("turn")))
    counts = rows.groupBy(key, "span").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).filter("start > 0")
    order = Window.partitionBy(key, "span").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return placed.join(starts, [key, "span"], "left").withColumn("pos", F.col("place") + F.coalesce("start", F.lit(0))).drop("span", "place", "start")
