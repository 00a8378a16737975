"""Similarity and graphs: TF-IDF pairs by an inverted index, connected components, coordination, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.sources.shared import kept, shared_dir


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Cells that vectors are dealt into, those that a query looks at first, and vectors of a block of a cell.
CELLS, FIRST, BLOCK = 64, 4, 8192


def _unit(values: list) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_cells(pivots: np.ndarray):
    """Vectors with the cell of the pivot that they are nearest to, and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = _unit(b.column("v").to_pylist()) @ pivots.T if len(b) else np.zeros((0, len(pivots)))
            cell = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(b)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    return place


def _bounds(pivots: np.ndarray, radius: np.ndarray):
    """Greatest cosine that a query may have with a vector of each cell."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = np.arccos(np.clip(_unit(b.column("v").to_pylist()) @ pivots.T, -1, 1)) if len(b) else np.zeros((0, len(pivots)))
            top = np.cos(np.maximum(angle - radius, 0)) + 1e-9
            for i, (q, v) in enumerate(zip(b.column("query_id").to_pylist(), b.column("v").to_pylist(), strict=True)):
                cells = np.flatnonzero(radius >= 0)
                n = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array([v] * n, pa.list_(pa.float64())), pa.array(cells, pa.int32()), pa.array(top[i, cells])], ["query_id", "v", "cell", "bound"])

    return bound


def _best_of_block(k: int):
    """The k best vectors of a block for each query that meets it, and those that rounding may put before them."""

    def best(members: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(members) and len(queries):
            ids = np.array(members.column("vec_id").to_pylist())
            x = _unit(members.column("v").to_pylist())
            for at in range(0, len(queries), 256):
                names = queries.column("query_id").to_pylist()[at : at + 256]
                score = _unit(queries.column("v").to_pylist()[at : at + 256]) @ x.T
                score[ids[None, :] == np.array(names)[:, None]] = -np.inf
                least = np.sort(score, axis=1)[:, -min(k, score.shape[1])] - 2e-5
                i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                for column, values in zip(out, ([names[q] for q in i], ids[j].tolist(), score[i, j].tolist()), strict=True):
                    column += values
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine to five decimals (ties: the lesser id), of all vectors.

    Vectors go to the cell of the nearest of CELLS pivots, which come from the vectors with the least digests. A cell's
    greatest angle to its pivot bounds the cosine that a query may have with any of its vectors. A query meets the
    cells of the highest bounds first, and then those whose bound reaches the k-th cosine found; a cell's vectors are
    dealt into blocks. Vectors that are null, empty, zero or hold nulls are near to nothing. All have one length.
    """
    spark = vectors.sparkSession
    sound = lambda df, id: df.select(F.col("vec_id").cast("long").alias(id), F.col("embedding").cast("array<double>").alias("v")).filter("v is not null and size(v) > 0 and forall(v, c -> c is not null) and exists(v, c -> c <> 0)")
    rows = kept(sound(vectors, "vec_id"), "vectors")
    pivots = [r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(CELLS).collect()]
    kind = "query_id long, vec_id long, place int, score double"
    if not pivots:
        return spark.createDataFrame([], kind)
    pivots = _unit(pivots)
    placed = kept(rows.mapInArrow(_in_cells(pivots), "vec_id long, v array<double>, cell int, angle double"), "cells")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()  # at most CELLS rows
    radius, blocks = np.full(len(pivots), -1.0), [1] * len(pivots)
    for r in sizes:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], r["blocks"]
    count = F.element_at(F.array(*map(F.lit, blocks)), F.col("cell") + 1).cast("long")
    dealt = placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), count).alias("block"))
    bounds = kept(sound(queries, "query_id").mapInArrow(_bounds(pivots, radius), "query_id long, v array<double>, cell int, bound double"), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        asked = pairs.select("query_id", F.col("v").alias("v"), F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
        return dealt.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(_best_of_block(k), "query_id long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        found = found.withColumn("score", F.round("score", 5))
        return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k)

    ahead = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))
    begun = bounds.withColumn("n", ahead).filter(F.col("n") <= FIRST).drop("n")
    found = kept(top(scored(begun)), "found")
    least = found.filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).join(begun.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
    return top(found.drop("place").unionByName(scored(rest))).select("query_id", "vec_id", "score", "place")


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, weight: tokens of two word characters or more, idf = ln((1 + n) / (1 + df)) + 1, length one."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).alias("token"))
    tf = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(df, "token").crossJoin(n).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "token", (F.col("w") / norm).alias("weight"))


#: The share of a vector's squared weights, in its rarer tokens, by which candidates are found and bounded.
HALF = 0.5


def similar_pairs(weights: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Pairs whose cosine reaches the threshold.

    Vectors have length one. A document's commonest tokens, as long as their squared weights sum up to less than
    least**2, can give less than `least` with any other document, so that they may be left out on one side: by
    Cauchy and Schwarz a pair that reaches the threshold shares one of the rarer tokens, which are looked up among all
    tokens of the others. HALF of a vector, at least, is looked up, so that what the rest can add is small: pairs that
    can't reach the threshold with it are dropped, and the others are summed in full.
    """
    df = weights.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy(key).orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)
    ranked = weights.join(df.filter("df > 1"), "token").withColumn("mass", F.sum(F.col("weight") * F.col("weight")).over(w))
    looked = F.col("mass") >= min(least * least, HALF) - 1e-9
    rest = ranked.groupBy(key).agg(F.coalesce(F.max(F.when(~looked, F.col("mass"))), F.lit(0.0)).alias("rest")).select(F.col(key).alias("a"), "rest")
    keys = ranked.filter(looked).select(F.col(key).alias("a"), "token", F.col("weight").alias("wa"))
    # tokens of one document only add to no pair
    x, y = ranked.select(F.col(key).alias("a"), "token", F.col("weight").alias("wa")), ranked.select(F.col(key).alias("b"), "token", F.col("weight").alias("wb"))
    met = keys.join(y, "token").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wb") * F.col("wb")).alias("used"))
    pairs = met.join(rest, "a").filter(F.col("dot") + F.sqrt(F.col("rest") * F.greatest(1 - F.col("used"), F.lit(0.0))) >= least - 1e-9).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).filter(F.col("score") >= least)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (least reachable id) of a table with a and b, by passing labels on and shortcutting them."""
    shared_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("id"), "c").checkpoint()
    for _ in range(rounds):
        passed = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("n"))
        step = labels.join(passed, F.col("id") == F.col("a"), "left").select("id", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        jump = step.select(F.col("id").alias("i"), F.col("c").alias("d"))
        new = step.join(jump, F.col("c") == F.col("i"), "left").select("id", F.least("c", "d").alias("c"), "old").checkpoint()
        changed = new.filter("c <> old").isEmpty()
        labels = new.select("id", "c")
        if changed:
            return labels.select("id", F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def bursts(posts: DataFrame, cluster: str, handle: str, time: str, least: int = 3) -> DataFrame:
    """Score of each cluster with enough handles: half by their number, half by how close in time they are."""
    got = posts.groupBy(cluster).agg(F.count_distinct(handle).alias("handles"), ((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 6e7).alias("span")).filter(F.col("handles") >= least)
    burst = F.when(F.col("span") <= 60, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("span") - 60) / 1440))
    return got.withColumn("score", F.round(0.5 * F.least(F.lit(1.0), (F.col("handles") - 2) / 12) + 0.5 * burst, 4))


def bigram_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Dice score of the multisets of letter pairs of two strings, 100 if they are equal."""
    grams = lambda c: F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).cast("string")))
    both = F.size(F.array_intersect(numbered(grams(F.lower(F.col(a)))), numbered(grams(F.lower(F.col(b))))))
    total = F.size(grams(F.lower(F.col(a)))) + F.size(grams(F.lower(F.col(b))))
    return pairs.withColumn("score", F.when(F.lower(F.col(a)) == F.lower(F.col(b)), 100.0).otherwise(F.coalesce(F.try_divide(200.0 * both, total), F.lit(0.0))))
