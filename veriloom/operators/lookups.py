"""Joins and lookups: suffix, n-gram, interval, tiered, fuzzy and look-alike joins.

Dimension sides carry no broadcast hint: Spark broadcasts them where their size allows and joins by sort-merge beyond.
"""

from __future__ import annotations

import difflib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veriloom.functions.text import host_suffixes, letter_skeleton
from veriloom.sources.shared import kept


#: Observations of a block, by which pairs are counted in tables of a block by a block; fewest blocks; pairs that are made at once.
BLOCK, BLOCKS, AT_ONCE = 4096, 8, 1 << 21


def _reach(of: np.ndarray, to: np.ndarray, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two sorted arrays of times that lie within gap, AT_ONCE or those of one time at once."""
    low, high = np.searchsorted(to, of - gap, "left"), np.searchsorted(to, of + gap, "right")
    ends, at = np.cumsum(high - low), 0
    while at < len(of):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        n = (high - low)[at:until]
        yield np.repeat(np.arange(at, until), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:until], n)
        at = until


def _counted_in_tiles(gap: int, least: int, size: int, kind: pa.Schema):
    """Pairs with their counts of rows (tile, e, us, side, n, obs) in the order of tile, e and us."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, counts, names, rest = None, None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if counts is not None:
                found = np.flatnonzero(counts >= least)
                for i in range(0, len(found), 100_000):
                    x, y = names[0][found[i : i + 100_000] // size], names[1][found[i : i + 100_000] % size]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(x < y, x, y), kind[0].type), pa.array(np.where(x < y, y, x), kind[1].type), pa.array(counts[found[i : i + 100_000]], pa.int64())], schema=kind)

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "e", "us", "side", "n", "obs")]
            cuts = [0, *(np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1), len(batch)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                t, e, us, side, n, obs = (c[i:j] for c in columns)
                if tile != t[0]:
                    yield from done()
                    tile, counts, names, rest = t[0], np.zeros(size * size, np.int32), [np.empty(size, obs.dtype) for _ in range(2)], None
                for k in (0, 1):  # in a tile of one block all rows are of both sides
                    names[k][n[side == k]] = obs[side == k]
                    if side[0] == 2:
                        names[k][n] = obs
                kept_rows = rest[1:] if rest is not None and rest[0] == e[0] else tuple(c[:0] for c in (us, side, n))
                every = [np.concatenate(c) for c in zip(kept_rows, (us, side, n), strict=True)]
                if side[0] == 2:
                    start = len(kept_rows[0])
                    for p, q in _reach(us, every[0], gap):
                        p, q = p[before := q < p + start], q[before]
                        x, y = n[p], every[2][q]
                        np.add.at(counts, (np.minimum(x, y) * size + np.maximum(x, y))[x != y], 1)
                else:
                    for (u, s_, m), (v, r, o) in (((us, side, n), every), (kept_rows, (us, side, n))):
                        # new rows of the first side with all of the second, and earlier ones of the first with new ones
                        m, o, u, v = m[s_ == 0], o[r == 1], u[s_ == 0], v[r == 1]
                        for p, q in _reach(u, v, gap):
                            np.add.at(counts, m[p] * size + o[q], 1)
                late = every[0] >= every[0][-1] - gap
                rest = (e[0], *(c[late] for c in every))
        yield from done()

    return run


def _shared_in_tiles(s: DataFrame, gap: int, least: int, blocks: int) -> DataFrame:
    """Pairs of observations by tiles of two blocks: each row goes to as many tiles as there are blocks, and no pairs are
    shuffled, however many share an entity."""
    named = s.select("obs").distinct().withColumn("block", F.pmod(F.xxhash64("obs"), F.lit(blocks)).cast("int"))
    named = kept(named.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("obs")) - 1), "observations")
    size = named.agg(F.max("n")).first()[0]
    own = kept(s.select("type", "value").distinct().withColumn("e", F.monotonically_increasing_id()), "entities")
    rows = s.join(own, ["type", "value"]).join(named, "obs").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    rows = rows.select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("tile"), "e", F.unix_micros("ts").alias("us"), side.alias("side"), F.col("n").cast("long").alias("n"), "obs")
    kind = T.StructType([T.StructField("a", s.schema["obs"].dataType), T.StructField("b", s.schema["obs"].dataType), T.StructField("shared", T.LongType())])
    counted = _counted_in_tiles(gap, least, (size or 0) + 1, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kind]))
    return rows.repartition("tile").sortWithinPartitions("tile", "e", "us").mapInArrow(counted, kind)


def shared_entities(sightings: DataFrame, days: int = 30, least: int = 2) -> DataFrame:
    """Pairs of observations that share so many entities within so many days.

    sightings has obs, ts, type, value. Entities seen once can't tie anything and leave before the join. Where more pairs
    would be made than rows of tiles, pairs are counted in tiles.
    """
    s = sightings.select("obs", "ts", "type", "value").distinct()
    often = s.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    s = kept(s.join(often, ["type", "value"], "left_semi").filter("obs is not null and ts is not null"), "sightings")
    gap = days * 86_400_000_000
    met = s.groupBy("type", "value", F.floor(F.unix_micros("ts") / max(gap, 1))).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
    blocks = max(BLOCKS, math.ceil(s.agg(F.approx_count_distinct("obs")).first()[0] / BLOCK))
    if least > 0 and (met["pairs"] or 0) > 2 * blocks * met["rows"]:
        return _shared_in_tiles(s, gap, least, blocks)
    a, b = s.alias("a"), s.alias("b")
    near = (F.col("a.type") == F.col("b.type")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.obs") < F.col("b.obs")) & (F.abs(F.unix_micros("a.ts") - F.unix_micros("b.ts")) <= gap)
    return a.join(b, near).groupBy(F.col("a.obs").alias("a"), F.col("b.obs").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def time_neighbours(rows: DataFrame, keys: list[str], time: str, id: str, days: float) -> DataFrame:
    """Pairs a, b of ids of a key's rows that follow one another in time within so many days.

    Whatever lies within the span of a row is tied to it through such pairs. Rows are sorted in spans of that length,
    of which the ends are then compared, so that a key with a third of all rows is many groups.
    """
    gap = int(days * 86_400_000_000)
    rows = rows.select(*keys, F.struct(F.unix_micros(time).alias("us"), F.col(id).alias("id")).alias("x")).withColumn("span", F.floor(F.col("x.us") / gap))
    before = F.lag("x").over(Window.partitionBy(*keys, "span").orderBy("x"))
    pair = lambda x, y: (x["id"].alias("a"), y["id"].alias("b"))
    within = rows.withColumn("p", before).filter("p is not null").select(*pair(F.col("p"), F.col("x")))
    ends = rows.groupBy(*keys, "span").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    ends = ends.withColumn("p", F.lag("last").over(Window.partitionBy(*keys).orderBy("span"))).filter(F.col("first.us") - F.col("p.us") <= gap)
    return within.unionByName(ends.select(*pair(F.col("p"), F.col("first")))).filter("a <> b")


def entity_ties(sightings: DataFrame, days: float = 30) -> DataFrame:
    """Pairs a, b of observations that share two entities within so many days, enough of them to tie all that do.

    Two observations share two entities if they share a pair of entities, so that those of one pair are compared with
    their neighbours in time only: what is sorted grows with the observations, not with the square of those that share
    an entity. sightings has obs, ts (one an observation), type, value; an observation's entities are few.
    """
    s = sightings.select("obs", "ts", F.struct("type", "value").alias("e")).distinct()
    often = s.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = s.join(often, "e", "left_semi").groupBy("obs", "ts").agg(F.array_sort(F.collect_set("e")).alias("es"))
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(F.filter("es", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return time_neighbours(own.select("obs", "ts", F.explode(pairs).alias("pair")), ["pair"], "ts", "obs", days)


def or_join(left: DataFrame, right: DataFrame, keys: dict[str, str], left_id: str, right_id: str) -> DataFrame:
    """Candidates that agree in any of several keys: one equi-join a key, united, each pair once."""
    out = None
    for i, (a, b) in enumerate(keys.items()):
        got = left.select(left_id, F.col(a).alias("_k")).join(right.select(right_id, F.col(b).alias("_k")), "_k").select(left_id, right_id)
        out = got if i == 0 else out.unionByName(got)
    return out.distinct()


def date_window(candidates: DataFrame, key: str, a: str, b: str, days: int = 45) -> DataFrame:
    """Candidates within so many days; all of a key's if none is."""
    near = F.abs(F.datediff(a, b)) <= days
    any_ = F.max(near).over(Window.partitionBy(key))
    return candidates.withColumn("_near", near).withColumn("_any", any_).filter(F.col("_near") | ~F.coalesce("_any", F.lit(False))).drop("_near", "_any")


def later(rows: DataFrame, key: str, time: str, marked: str, days: int = 60) -> DataFrame:
    """Rows that a marked row of the same key follows within so many days.

    One window a key, from the latest row backwards, carries the next marked time: linear in a key's rows.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    after = Window.partitionBy(key).orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    next_ = F.min(F.when(F.col(marked), F.col("_t"))).over(after)
    return rows.withColumn("_t", micros).withColumn("_next", next_).filter(F.col("_next") <= F.col("_t") + days * 86_400_000_000).drop("_t", "_next")


def by_suffix(hosts: DataFrame, host: str, listed: DataFrame, name: str = "host") -> DataFrame:
    """The longest listed suffix of each host, by an equi-join on all suffixes."""
    parts = hosts.withColumn("_s", F.explode(host_suffixes(F.col(host))))
    got = parts.join(listed.select(F.col(name).alias("_s"), *[c for c in listed.columns if c != name]), "_s")
    others = [c for c in listed.columns if c != name]
    return got.groupBy(*hosts.columns).agg(F.max_by(F.struct(F.col("_s").alias("matched"), *others), F.length("_s")).alias("m")).select(*hosts.columns, "m.*")


#: Slots that words and names are hashed to, whatever their number, by which texts' words are told apart before they leave a task.
SLOTS = 1 << 20


def _slots(values: DataFrame, column: str) -> bytes:
    """The slots that a column's values take, as bits."""
    slot = F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(SLOTS)).cast("int")
    taken = np.zeros(SLOTS, dtype=bool)
    taken[[i for r in values.groupBy(F.pmod(slot, F.lit(64)).alias("part")).agg(F.collect_set(slot).alias("slots")).collect() for i in r["slots"]]] = True
    return np.packbits(taken, bitorder="little").tobytes()


def _maybe_names(sizes: list[int], words: bytes, whole: bytes):
    """Runs of so many words of a text that may be names: all of a name's words, and the name, have a slot."""

    def taken(bits: bytes, value: str) -> int:
        h = zlib.crc32(value.encode()) % SLOTS
        return bits[h >> 3] >> (h & 7) & 1

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, good = set(), set()
        for batch in batches:
            out = []
            for t in batch:
                here = re.findall("[a-z0-9#]+", (t or "").lower())
                if len(known) >= 1 << 17:
                    known, good = set(), set()
                fresh = set(here) - known
                known |= fresh
                good.update(w for w in fresh if taken(words, w))
                at = [i for i, w in enumerate(here) if w in good]
                found = {" ".join(here[i : i + n]) for n in sizes for i, j in zip(at, at[n - 1 :], strict=False) if j - i == n - 1}
                out.append([g for g in found if taken(whole, g)])
            yield pd.Series(out, dtype=object)

    return run


def names_in_text(docs: DataFrame, key: str, text: str, names: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """Names of low to high words that occur as whole word sequences in texts; names has name, normalised.

    What leaves a text are the word sequences that may be names, by slots of a fixed number; these meet the names
    themselves. The names are written first, so that Spark knows their size.
    """
    words = F.split("normalised", " ")
    known = kept(names.select("name", "normalised").distinct().filter(F.col("normalised").rlike("^[a-z0-9#]+( [a-z0-9#]+)*$") & F.size(words).between(low, high)), "names")
    sizes = sorted(r[0] for r in known.select(F.size(words)).distinct().collect())
    may = _maybe_names(sizes, _slots(known.select(F.explode(words).alias("word")), "word"), _slots(known, "normalised"))
    return docs.select(key, F.explode(may(F.col(text))).alias("gram")).join(known.select("name", F.col("normalised").alias("gram")), "gram").select(key, "name").distinct()


def longest_name(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"))


@F.pandas_udf(T.DoubleType())
def set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest ratio of common words against either side's words, 0 to 100; word order doesn't count."""

    def one(x: str, y: str) -> float:
        u, v = set(x.split()), set(y.split())
        both, left, right = " ".join(sorted(u & v)), " ".join(sorted(u - v)), " ".join(sorted(v - u))
        p, q = f"{both} {left}".strip(), f"{both} {right}".strip()
        pairs = ((both, p), (both, q), (p, q)) if both else ((p, q),)
        return 100 * max(difflib.SequenceMatcher(None, s, t).ratio() for s, t in pairs)

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def _prefixes(grams: DataFrame, by: list[str], df: DataFrame, what: str, size, keep) -> DataFrame:
    """The rows of grams that must be looked up: the rarest of each name, as long as keep(size of rarer ones) holds."""
    before = Window.partitionBy(*by).orderBy(F.coalesce("_n", F.lit(0)), what).rowsBetween(Window.unboundedPreceding, -1)
    ranked = grams.join(df, what, "left").withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return ranked.filter(keep(F.col("_before"))).select(*by, what)


def candidates(names: DataFrame, key: str, name: str, register: DataFrame, least: float) -> DataFrame:
    """key, name, registered, normalised and common (whether they share a word) of all pairs that set_ratio may give `least`.

    With r = least / 100, either the common words fill r / (2 - r) of one side, so that one of its rarest words is among
    them; or the sides of lengths p and q have runs in common that hold (1.5 r - 1)(p + q) + 1 of the bigrams of their
    words, so that one of the rarest bigrams of each is the same. All lengths of names and frequencies of words count.
    """
    r = least / 100
    fill, slope = r / (2 - r), 1.5 * r - 1
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))
    pairs_of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string")))

    def side(df: DataFrame, text: str, x: str) -> DataFrame:
        df = df.withColumn(f"_w{x}", words(F.col(text))).filter(F.size(f"_w{x}") > 0)
        df = df.withColumn(f"_l{x}", F.length(F.array_join(f"_w{x}", " "))).withColumn(f"_g{x}", F.flatten(F.transform(f"_w{x}", pairs_of)))
        return df.withColumn(f"_g{x}", numbered(F.col(f"_g{x}")))

    a = side(names.select(key, name).distinct(), name, "a")
    b = side(register.select("registered", "normalised").distinct(), "normalised", "b")
    ka, kb = [key, name], ["registered", "normalised"]
    if slope > 0:
        wa, wb = a.select(*ka, "_la", F.explode("_wa").alias("_w")), b.select(*kb, "_lb", F.explode("_wb").alias("_w"))
        ga, gb = a.select(*ka, "_la", F.explode("_ga").alias("_g")), b.select(*kb, "_lb", F.explode("_gb").alias("_g"))
        dw, dg = (x.groupBy(c).agg(F.count(F.lit(1)).alias("_n")) for x, c in ((wb, "_w"), (gb, "_g")))
        missing = lambda x: lambda before: before <= F.col(x) * (1 - fill) + 1e-6
        few = lambda x: lambda before: before <= F.col(x) + 1 - F.ceil(F.col(x) * slope * (1 + fill) + 1 - 1e-6)
        width = F.length("_w") + 1
        met = [
            _prefixes(wa, [*ka, "_la"], dw, "_w", width, missing("_la")).join(wb, "_w"), _prefixes(wb, [*kb, "_lb"], dw, "_w", width, missing("_lb")).join(wa, "_w"),
            _prefixes(ga, [*ka, "_la"], dg, "_g", F.lit(1), few("_la")).join(_prefixes(gb, [*kb, "_lb"], dg, "_g", F.lit(1), few("_lb")), "_g"),
        ]
        met = [x.select(*ka, *kb, "_la", "_lb") for x in met]
        # the lengths allow it, before sides are looked up again
        met[2] = met[2].filter(F.least("_la", "_lb") >= fill * F.greatest("_la", "_lb") - 1e-6)
        found = met[0].unionByName(met[1]).unionByName(met[2]).select(*ka, *kb).distinct()
        both = found.join(a, ka).join(b, kb)
    else:
        both = a.crossJoin(b)
    same = F.array_intersect("_wa", "_wb")
    both = both.withColumn("_lc", F.length(F.array_join(same, " "))).withColumn("_shared", F.size(F.array_intersect("_ga", "_gb")))
    filled = (F.col("_lc") > 0) & (F.col("_lc") >= fill * F.least("_la", "_lb") - 1e-6)
    alike = (F.least("_la", "_lb") >= fill * F.greatest("_la", "_lb") - 1e-6) & (F.col("_shared") >= slope * (F.col("_la") + F.col("_lb")) + 1 - 1e-6)
    return both.filter(filled | alike).select(*ka, *kb, (F.col("_lc") > 0).alias("common"))


def _within(names: DataFrame, key: str, name: str, register: DataFrame) -> DataFrame:
    """key and registered of names whose words are all among a registered name's, or the other way round: those, and
    no others, have a ratio of 100. They meet in the smaller side's rarest word of the register."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))
    a = names.select(key, words(F.col(name)).alias("_wa")).filter(F.size("_wa") > 0).distinct()
    b = register.select("registered", words(F.col("normalised")).alias("_wb")).filter(F.size("_wb") > 0).distinct()
    ea, eb = a.withColumn("_w", F.explode("_wa")), b.withColumn("_w", F.explode("_wb"))
    df = eb.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    # a word that the register lacks is in no registered name: what holds one is within none
    rarest = lambda rows, *by: rows.join(df, "_w", "left").groupBy(*by).agg(F.min_by("_w", F.struct(F.coalesce("_n", F.lit(0)), F.col("_w"))).alias("_w"))
    inside = rarest(eb, "registered", "_wb").join(ea, "_w").filter(F.size(F.array_except("_wb", "_wa")) == 0).select(key, "registered")
    around = rarest(ea, key, "_wa").join(eb, "_w").filter(F.size(F.array_except("_wa", "_wb")) == 0).select(key, "registered")
    return inside.unionByName(around)


def resolve(names: DataFrame, key: str, name: str, register: DataFrame, least: float = 85.0, alone: float = 92.0) -> DataFrame:
    """Registered name of each name: equal first, then the best word-set ratio of all names in the register.

    Names that reach a ratio of 100 are settled before all others that may be alike are looked up. Without a common
    word, the ratio must reach `alone`. register has registered, normalised.
    """
    exact = names.join(register, F.col(name) == F.col("normalised")).select(key, "registered", F.lit(100.0).alias("score"))
    rest = names.join(exact.select(key), key, "left_anti")
    if least <= 100:
        full = kept(_within(rest, key, name, register).groupBy(key).agg(F.max("registered").alias("registered")).select(key, "registered", F.lit(100.0).alias("score")), "full")
        exact, rest = exact.unionByName(full), kept(rest.join(full.select(key), key, "left_anti"), "rest")
    scored = candidates(rest, key, name, register, least).withColumn("score", set_ratio(F.col(name), F.col("normalised")))
    scored = scored.filter((F.col("score") >= least) & (F.col("common") | (F.col("score") >= alone)))
    best = scored.groupBy(key).agg(F.max_by(F.struct("registered", "score"), F.struct(F.col("score"), F.col("registered"))).alias("b")).select(key, "b.*")
    return exact.unionByName(best)


def lookalikes(hosts: DataFrame, key: str, label: str, known: DataFrame, edits: int = 2, least: int = 5, skeletons: bool = True) -> DataFrame:
    """The first known name, in its order, that a label imitates: equal skeleton before few edits.

    known has name and ord. Skeletons meet in an equi-join. For edits, both sides are cut into edits + 1 parts by the
    name's length; one part is unchanged within `edits` places of its own, so that equal parts are candidates.
    """
    left = hosts.select(key, F.col(label).alias("_l"))
    skeleton = left.join(known.select("name", "ord", letter_skeleton(F.col("name")).alias("_k")), letter_skeleton(F.col("_l")) == F.col("_k")).filter(F.col("_l") != F.col("name")).select(key, "name", "ord", F.lit(0).alias("how"), F.lit(0).alias("d"))
    n = edits + 1
    size = F.floor(F.length("name") / n).cast("int")
    part = lambda i: F.struct((F.lit(i) * size).alias("at"), F.substring(F.col("name"), F.lit(i) * size + 1, F.when(F.lit(i == n - 1), F.length("name")).otherwise(size)).alias("part"))
    pieces = known.filter(F.length("name") >= least).select("name", "ord", F.explode(F.array(*[part(i) for i in range(n)])).alias("p")).select("name", "ord", "p.*")
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.length("_l") - edits, F.lit(1)), F.length("_l") + edits), lambda m: F.array(F.floor(m / n), m - (n - 1) * F.floor(m / n)))))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_l"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda s: F.transform(starts, lambda a: F.substring(F.col("_l"), a, s.cast("int"))))))
    probe = left.withColumn("part", F.explode(grams))
    near = probe.join(pieces, "part").select(key, "_l", "name", "ord").distinct()
    near = near.withColumn("d", F.levenshtein("_l", "name", edits)).filter("d > 0").select(key, "name", "ord", F.lit(1).alias("how"), "d")
    both = skeleton.unionByName(near) if skeletons else near
    return both.groupBy(key).agg(F.min(F.struct("how", "d", "ord", "name")).alias("m")).select(key, F.col("m.name").alias("name"), F.col("m.d").alias("edits"))


def priority(rows: DataFrame, key: str, rank: str, value: str) -> DataFrame:
    """The value of the lowest rank of each key."""
    return rows.groupBy(key).agg(F.min_by(value, rank).alias(value))


def seen_with(sightings: DataFrame, type_a: str, type_b: str) -> DataFrame:
    """Values of one type and those of another that were seen in one observation, with the number of observations.

    sightings has obs, type, value; both sides meet by the observation, each value once.
    """
    a = sightings.filter(F.col("type") == type_a).select("obs", "value").distinct()
    b = sightings.filter(F.col("type") == type_b).select("obs", F.col("value").alias("with_value")).distinct()
    return a.join(b, "obs").groupBy("value", "with_value").agg(F.count(F.lit(1)).alias("n"))


def by_prefix(rows: DataFrame, code: str, listed: DataFrame, prefix: str, size: int) -> DataFrame:
    """Rows with the columns of the entry whose prefix begins their code; entries have distinct prefixes of one size."""
    return rows.join(listed, F.upper(F.substring(F.trim(code), 1, size)) == F.upper(prefix), "left").drop(prefix)


def feed_agreement(rows: DataFrame, key: str, host: str, flagged: DataFrame, feeds: int) -> DataFrame:
    """How many feeds flag a host, which, and the confidence that their number gives; unknown hosts have none.

    flagged has host and feed. Half is given for one hit, the other half by the share of all feeds.
    """
    named = flagged.groupBy(F.col("host").alias("_h")).agg(F.array_sort(F.collect_set("feed")).alias("named"))
    both = rows.join(named, F.col(host) == F.col("_h"), "left")
    n = F.coalesce(F.size("named"), F.lit(0))
    n = F.when(F.col("named").isNull(), 0).otherwise(n)
    return both.select(key, n.alias("feeds"), F.coalesce("named", F.array().cast("array<string>")).alias("named"), F.round(F.when(n > 0, 0.5 + 0.5 * n / feeds).otherwise(0.0), 4).alias("confidence"))


def unlisted(rows: DataFrame, number: str, listed: DataFrame, known: str) -> DataFrame:
    """Numbers of rows, each once, that no listed row has: made up, or of something that isn't registered."""
    return rows.select(number).filter(F.col(number).isNotNull()).distinct().join(listed.select(F.col(known).alias(number)), number, "left_anti")
