"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies, target words over source words. Its whole part
is taken outright; the fraction is an inclusion probability that the cube method settles while it holds two totals,
words and documents, at their expected values. The flight phase runs in blocks of a bounded number of rows: each
block walks in the null space of its two constraints until at most two fractions are left. The survivors of all
blocks meet in fewer blocks, and so on, until one block per source is left. Its last few fractions, those of the
largest documents, are the landing problem: all ways to take them are tried for the nearest totals.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import save, word_count

EPS = 1e-9
#: So many fractions make the landing problem.
LANDING = 14


def source_targets(units: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, units, target of a table with source, size, rows.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops
    at cap times its source's size; the excess goes to the others by weight. The windows run over one row a source.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", choice)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    capped = cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("at", F.row_number().over(by_ratio)).withColumn("level", (total - capped) / left)
    fits = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    first = F.min(F.when(fits, F.col("at"))).over(everything)
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("at"))).over(everything)
    per = per.withColumn("first", first).withColumn("chosen", level)
    return per.select("source", "source_size", "units", F.when(F.col("at") < F.col("first"), cap * F.col("source_size")).otherwise(F.col("chosen") * F.col("weight")).cast("double").alias("target"))


def _move(p: list, at: list, u: tuple, rng) -> None:
    """Moves the fractions at the places at along u or against it, as far as the unit cube allows, with the right odds."""
    up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(at, u, strict=True) if v)
    down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(at, u, strict=True) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in zip(at, u, strict=True):
        p[i] += step * v
        p[i] = 0.0 if p[i] < EPS else 1.0 if p[i] > 1 - EPS else p[i]


def flight(sizes: list, p: list, rng, land: bool) -> list:
    """Settles fractions with the totals of sizes and of units held; leaves two fractions at most, none if land.

    For the landing, the last LANDING fractions, of the largest units as the rows come by rising size, are kept apart
    and settled by trying all ways to take them for the one whose words, and then whose units, are nearest.
    """
    open_ = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    live: list[int] = []
    for done, i in enumerate(open_):
        if land and len(live) + len(open_) - done <= LANDING:
            live += open_[done:]
            break
        live.append(i)
        if len(live) == 3:
            a, b, c = (sizes[k] for k in live)
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
            _move(p, live, u, rng)
            live = [k for k in live if 0.0 < p[k] < 1.0]
    if land and live:
        ways = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
        off = ways - np.array([p[k] for k in live])
        words, units = np.abs(off @ np.array([float(sizes[k]) for k in live])), np.abs(off.sum(axis=1))
        best = np.lexsort((units, words.round(6)))[0]
        for k, taken in zip(live, ways[best].tolist(), strict=True):
            p[k] = float(taken)
    elif len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
        _move(p, live, (1, -1), rng)
    return p


def _settle(land: bool, seed: int):
    order = ["size", "order", "doc_id"] if land else ["order", "size", "doc_id"]

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="last").reset_index(drop=True)
        name = f"{seed}|{'' if key[0] is None else 's' + str(key[0])}|{key[1]}|{land}"
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode())))
        rows["p"] = flight((rows["size"] * rows["rows"]).tolist(), rows["p"].tolist(), rng, land)
        return rows

    return block


def cube_mix(units: DataFrame, *, weights=(5, 2, 1), cap: float = 3.0, block_rows: int = 2048, seed: int = 17) -> DataFrame:
    """Copies of each unit of a table with doc_id, source, size and rows (how many rows share those three values).

    Returns doc_id, source, size, source_size, target, copies (int, 0 to cap). Units without words get no copies. A
    source whose words are 0 gets the target 0. Rows that agree in doc_id, source and size are one unit and are
    taken alike. Nulls in doc_id or source are values like others. The result depends on values and seed only.
    """
    units = save(units, "mix-units")
    per = save(source_targets(units, weights, cap), "mix-targets")
    fields = ["doc_id", "source", "size", "rows", "source_size", "target", "order", "p", "whole", "blocks", "land_block"]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + EPS)
    rows = (
        units.alias("u")
        .join(per.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("u.doc_id", "u.source", "u.size", "u.rows", "source_size", "target", F.xxhash64(F.lit(seed), F.col("u.doc_id"), F.col("u.size")).alias("order"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"), whole.cast("int").alias("whole"), F.ceil(F.col("units") / block_rows).cast("long").alias("blocks"), F.lit(0).cast("long").alias("land_block"))
        .withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > EPS), F.col("p")).otherwise(F.lit(0.0)))
    )
    most = units.count() and per.agg(F.max("units")).first()[0]
    parts = [rows.filter((F.col("p") <= 0) | (F.col("p") >= 1))]
    rows = rows.filter((F.col("p") > 0) & (F.col("p") < 1))
    blocks = math.ceil(most / block_rows)
    while True:
        land = blocks <= 1
        rows = rows.withColumn("land_block", F.pmod(F.col("order"), F.col("blocks")))
        rows = rows.groupBy("source", "land_block").applyInPandas(_settle(land, seed), rows.schema).select(*fields)
        rows = save(rows, "mix-round")
        parts.append(rows.filter((F.col("p") <= 0) | (F.col("p") >= 1)))
        if land:
            break
        rows = rows.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("blocks", F.greatest(F.ceil(F.col("blocks") * 2 / block_rows), F.lit(1)).cast("long"))
        blocks = math.ceil(blocks * 2 / block_rows)
    done = parts[0].select(*fields)
    for x in parts[1:]:
        done = done.unionByName(x)
    return done.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("int")).otherwise(F.lit(0)).cast("int").alias("copies"))


def mixing_units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, rows of documents: one row for all rows that agree in the first three."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: words that the mix takes of each document."""
    from veriloom.llm.common import table

    units = mixing_units(table(spark, sf_dir, "documents"))
    mixed = cube_mix(units)
    again = units.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), "rows").filter("rows > 1")
    joined = mixed.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")), "left")
    each = joined.withColumn("one", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("rows"), F.lit(1)).cast("int"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them; columns as before, whatever their names."""
    names = docs.columns
    mixed = cube_mix(mixing_units(docs), **options).filter("copies > 0")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (word_count(F.col("row.text")) == F.col("size"))
    return sized.join(mixed, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
