"""MinHash near-duplicates by an LSH forest.

A document is the set of its five-word shingles. A signature of 128 minimum hashes, 16 bits each, is read in TREES
orders, tree t from hash 8 * t on and around. The documents that agree in a tree's first four hashes are a region.

1. Equal sets become one vertex. Regions with one vertex only are left aside.
2. Each tree is sorted by its order, spread by ranges, so that a region of any size is cut where needed. Neighbours in
   that order have the longest common prefixes, as deep as the region is dense. Of a vertex's neighbours in all trees,
   the one that agrees best is confirmed on full sets. Confirmed links make first components.
3. What may still be missing are links between components. In regions that hold several, each vertex outside the
   region's largest component is held against all vertices of other components, in one join whose condition compares
   signatures, and full sets of up to SMALL shingles, so that only pairs that may reach the threshold come out, once
   for all trees; they are confirmed on full sets, and the components are joined. Groups of copies, of one component
   by now, cost nothing here. The depth of a region adapts to what it holds: one that would compare more than DENSE
   pairs (texts of one template, alike but below the threshold) is cut by the tree's next two hashes, and again.

A pair of similarity 0.85 shares a region with odds 1 - (1 - 0.85**4)**16 = 0.99999, in regions cut once with
1 - (1 - 0.85**6)**16 = 0.9995 and cut twice with 0.994; the signature test gives away four standard deviations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import save, small_batches, table, tidy
from veriloom.llm.components import components

HASHES, TREES, WORDS = 128, 16, 5
LONGS = HASHES // 4  # four hashes of 16 bits each
LANES = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -1 << 48)
COARSE = 4  # words that hold two bits of each hash
DEPTHS = (6, 8)  # hashes that dense regions are cut by
DENSE = 1 << 18  # pairs of one region that are compared directly
SMALL = 512  # sets of so many shingles at most are compared in full within the join itself

STORE = 100_000  # words whose hashes a task remembers

_rng = np.random.default_rng(20240607)
_TIMES = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TWIST = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; of fewer than five words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > STORE:
        _known.clear()
    for w in {*words}:
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([*map(_known.__getitem__, words)], dtype=np.uint64)
    n = max(len(h) - WORDS + 1, 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ (out >> np.uint64(32))) * _TWIST + h[k : k + n]
    out = (out ^ (out >> np.uint64(29))) * _TWIST
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(s: np.ndarray) -> np.ndarray:
    """LONGS 64-bit words that hold the low 16 bits of each minimum hash."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for lo in range(0, len(short), 8192):
        x = (short[None, lo : lo + 8192] ^ _PLUS[:, None]) * _TIMES[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=1))
    mixed = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return mixed.astype(np.uint16).view(np.int64)


def coarse(sig: np.ndarray) -> list[int]:
    """COARSE words with the lowest two bits of each hash: an unequal hash flips one of them on average."""
    h = sig.view(np.uint16)
    bits = np.concatenate([h & 1, (h >> 1) & 1]).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


@tidy
def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            s = shingles(text)
            sig = signature(s) if len(s) else None
            rows.append((doc_id, len(s), None, None, None) if sig is None else (doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tolist(), coarse(sig)))
        out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig", "coarse"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def _neighbours(reach: int, least: int):
    """Pairs of a row and the rows shortly before it in the same region that agree in enough hashes."""

    def pairs(x: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack(x["sig"].to_numpy()).astype(np.int64).view(np.uint16)
        tree, key, vertex = x["tree"].to_numpy(), x["key"].to_numpy(), x["vertex"].to_numpy()
        out = []
        for k in range(1, reach + 1):
            if len(x) > k:
                same = (tree[k:] == tree[:-k]) & (key[k:] == key[:-k])
                agree = (sig[k:] == sig[:-k]).sum(axis=1)
                at = np.flatnonzero(same & (agree >= least))
                out.append(pd.DataFrame({"a": vertex[at], "b": vertex[at + k], "agree": agree[at].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "agree": []}).astype({"a": "int64", "b": "int64", "agree": "int32"})

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if len(batch):
                batch = batch if last is None else pd.concat([last, batch], ignore_index=True)
                yield pairs(batch)
                last = batch.tail(reach)

    return run


@tidy
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"vertex": batch["vertex"], "set": [shingles(t).view(np.int64).tolist() for t in batch["text"]]})


def _agreement(a, b):
    """Native count of equal 16-bit lanes of two arrays of 64-bit words."""
    same = lambda d, k: (d.bitwiseAND(F.lit(LANES[k])) == 0).cast("int")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, d: n + same(d, 0) + same(d, 1) + same(d, 2) + same(d, 3))


def _linked(a, b, percent: int):
    """Whether two full sets reach the threshold; null if either isn't there."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), 100 * common >= percent * (F.size(a) + F.size(b) - common))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    one = pairs.join(sets.select(F.col("vertex").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(sets.select(F.col("vertex").alias("b"), F.col("set").alias("set_b")), "b")
    return both.filter(_linked(F.col("set_a"), F.col("set_b"), percent)).drop("set_a", "set_b")


def _regions(named: DataFrame, sigs: DataFrame, dense: int) -> DataFrame:
    """tree, key, vertex, component and main (the region's largest component) of the regions that hold several.

    named has tree, key, vertex and component, one row for each tree of a vertex. Regions with more than `dense` pairs
    to compare are cut by further hashes, as deep as DEPTHS go; key is a hash of the path then.
    """
    done, now = None, named
    for depth in (*DEPTHS, None):
        parts = now.groupBy("tree", "key", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = parts.groupBy("tree", "key").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter("kinds > 1")
        sizes = sizes.select("tree", "key", F.col("main.component").alias("main"), ((F.col("all") - F.col("main.n")) * F.col("all")).alias("pairs"))
        rows = save(now.join(sizes, ["tree", "key"]), "regions")
        if depth is None:
            kept = rows
        else:
            kept, crowded = rows.filter(F.col("pairs") <= dense), rows.filter(F.col("pairs") > dense)
        kept = kept.select("tree", "key", "vertex", "component", "main")
        done = kept if done is None else done.unionByName(kept)
        if depth is None or crowded.isEmpty():
            return done
        # a tree's hashes stand four in a word, from word 2 * tree on
        word = F.element_at("sig", F.pmod(2 * F.col("tree") + (depth - 1) // 4, F.lit(LONGS)).cast("int") + 1)
        two = word.bitwiseAND(F.lit((1 << 16 * (depth % 4)) - 1)) if depth % 4 else word
        now = crowded.drop("main", "pairs").join(sigs, "vertex").select("tree", F.xxhash64("key", F.lit(depth), two).alias("key"), "vertex", "component")


def near_duplicates(docs: DataFrame, percent: int = 85, reach: int = 2, dense: int = DENSE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of a table with doc_id (a long) and text.

    Links are pairs with 100 * intersection >= percent * union of their shingle sets. component_id is the least
    doc_id that links reach; kept where doc_id is that. A text without words (null, empty) has no shingles and no
    links. Rows with one doc_id are one document, whose texts' links meet. A row without doc_id is linked with
    nothing: its component_id is null and it is kept.
    """
    small_batches(docs.sparkSession)
    share = percent / 100
    least = math.floor(HASHES * share - 4 * math.sqrt(HASHES * share * (1 - share)))
    apart = 1 - share  # of the two bits of an unequal hash, none, one or two differ, in odds of 1, 2 and 1 to 4
    most = math.ceil(HASHES * apart + 4.5 * math.sqrt(HASHES * (1.5 * apart - apart * apart)))
    sketches = save(docs.select("doc_id", "text").mapInPandas(_sketch, "doc_id bigint, n_shingles bigint, digest binary, sig array<bigint>, coarse array<bigint>"), "sketches")
    known = sketches.filter("digest is not null and doc_id is not null")
    same = save(known.groupBy("digest").agg(F.min("doc_id").alias("vertex"), F.first("sig").alias("sig"), F.first("coarse").alias("coarse")), "vertices")
    roots = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.element_at("sig", 2 * t + 1).alias("key"))))
    keys = same.select("vertex", roots.alias("at")).select("vertex", "at.*")
    shared = keys.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keys.join(shared.drop("n"), ["tree", "key"])
    members = save(members.join(same.select("vertex", "sig"), "vertex"), "members")

    turned = F.slice(F.concat("sig", "sig"), 2 * F.col("tree") + 1, LONGS)
    ordered = members.withColumn("turned", turned).repartitionByRange("tree", "key", "turned", "vertex").sortWithinPartitions("tree", "key", "turned", "vertex").select("tree", "key", "vertex", "sig")
    near = save(ordered.mapInPandas(_neighbours(reach, least), "a bigint, b bigint, agree int"), "neighbours")
    ends = near.filter("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w"), "agree"), F.struct(F.col("b").alias("v"), F.col("a").alias("w"), "agree"))).alias("e")).select("e.*")
    best = ends.groupBy("v").agg(F.max(F.struct("agree", F.col("w").alias("w"))).alias("m")).select(F.least("v", "m.w").alias("a"), F.greatest("v", "m.w").alias("b")).distinct()
    # full sets of all vertices that share a region
    wanted = members.select("vertex").distinct()
    texts = docs.select(F.col("doc_id").alias("vertex"), "text").join(wanted, "vertex", "left_semi")
    sets = save(texts.mapInPandas(_sets, "vertex bigint, set array<bigint>").dropDuplicates(), "sets")
    links = save(_confirmed(best, sets, percent), "links")
    first = components(links)

    # links between components
    named = members.join(first, members["vertex"] == first["id"], "left").select("tree", "key", "vertex", F.coalesce("component", "vertex").alias("component"))
    inside = _regions(named, same.select("vertex", "sig"), dense)
    paths = inside.groupBy("vertex").agg(F.array_sort(F.collect_list(F.struct("tree", "key"))).alias("paths"))
    small = sets.filter(F.size("set") <= SMALL).withColumnRenamed("set", "small")
    coarse_words = [F.element_at("coarse", k + 1).alias(f"c{k}") for k in range(COARSE)]
    inside = save(inside.join(paths, "vertex").join(same.select("vertex", "sig", *coarse_words), "vertex").join(small, "vertex", "left"), "mixed")
    a, b = inside.filter("component <> main").alias("a"), inside.alias("b")
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.vertex") < F.col("b.vertex"))
    first_tree = F.try_element_at(F.array_intersect("a.paths", "b.paths"), F.lit(1)).getField("tree")
    flips = sum((F.bit_count(F.col(f"a.c{k}").bitwiseXOR(F.col(f"b.c{k}"))) for k in range(COARSE)), F.lit(0))
    condition = (F.col("a.tree") == F.col("b.tree")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once & (flips <= most) & (_agreement(F.col("a.sig"), F.col("b.sig")) >= least) & (first_tree == F.col("a.tree"))
    condition &= F.coalesce(_linked(F.col("a.small"), F.col("b.small"), percent), F.lit(True))
    across = save(a.join(b, condition).select(F.col("a.vertex").alias("a"), F.col("b.vertex").alias("b"), F.col("a.component").alias("ca"), F.col("b.component").alias("cb")), "across")
    more = save(_confirmed(across, sets, percent), "more-links")
    # components that these links join, by their names, the least vertex of each
    second = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))) if not more.isEmpty() else first.limit(0)

    named = sketches.join(same.select("digest", "vertex"), "digest", "left").join(first.select(F.col("id").alias("vertex"), F.col("component").alias("first")), "vertex", "left")
    named = named.withColumn("first", F.coalesce("first", "vertex")).join(second.withColumnRenamed("id", "first"), "first", "left")
    rows = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: shingles, component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the least doc_id; rows without doc_id stay. Columns as before."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row"), F.col("row.text"))
    found = rows.join(kept, F.col("row.doc_id") == F.col("doc_id"), "left_semi").withColumn("place", F.row_number().over(one)).filter("place = 1")
    return found.select("row.*").unionByName(docs.filter("doc_id is null"))
