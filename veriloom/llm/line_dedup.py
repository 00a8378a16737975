"""Line dedup by a segment-partition edit join.

Lines (white space around them aside) are compared over the whole corpus. Two lines of `least` characters or more are
alike if their edit distance is at most `edits`; shorter ones, down to `exact` characters, only if they are equal, and
still shorter ones (brackets, list marks) are left alone. Each line is cut into edits + 1 segments; by the pigeonhole
principle an alike line of the same or a smaller length by up to edits has one of its segments unchanged, near its own
place. So lines are indexed by length, place and hash of their segments, and probe with the few substrings that can
match a segment of each possible length. Hits must also agree in a parity sketch of character pairs (an edit flips
four bits at most), tested within the join, before a banded bit-parallel computation settles their distance.

A segment that many lines share (templates, near copies) would make its lines meet all at once. Segments of more than
HEAVY lines are taken out, one mark each stays to collect the lines that probe them, and these lines are joined by a second
key, the bands of a wider sketch: of 4 * edits + 1 bands at least one is equal in alike lines, so that nothing is lost,
and lines that share the segment only don't meet. Near copies beyond the edit distance still agree in most bands, so
that this join carries the lines themselves and settles the distance in its condition: it makes rows of links only.

Of equal lines, the one in the document with the least doc_id stays, and there the first. A line goes if an alike
line was seen first in an earlier document (in one document: has the lesser hash). Hot lines meet as hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import SPACES, save, small_batches, table, tidy

LEAST, EXACT, EDITS = 24, 8, 2
#: Lines that share a segment meet directly up to so many, by bands of their wide sketch and with their text beyond.
HEAVY = 32
#: Characters that a task works on at once.
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def edit_distance(a: str, b: str, k: int) -> int:
    """Levenshtein distance of a and b if it is k or less, else k + 1.

    Bit-parallel in a band: bit i of a column's vectors is the row i - k below the diagonal, so that the window of
    2k + 1 rows slides down by one row a column.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > k:
        return k + 1
    if not m:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    mask = (1 << (2 * k + 1)) - 1
    up, down = (((1 << (k + 1)) - 1) << k) & mask, 0
    score = 0
    for j in range(1, n + 1):
        at, hits = j - k - 1, where.get(b[j - 1], 0)
        eq = ((hits >> at) if at >= 0 else (hits << -at)) & mask
        zero = ((((eq & up) + up) ^ up) | eq | down) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        if j <= m:
            score += not zero >> k & 1
        else:
            row = m - j + k
            score += (plus >> row & 1) - (minus >> row & 1)
        up, down = (minus | ~((zero >> 1) | plus)) & mask, (zero >> 1) & plus
    return score if score <= k else k + 1


def segments(length, edits: int) -> list[tuple]:
    """Start and length of the edits + 1 segments of a line; the later ones are longer by one where it doesn't divide.

    Works on one length or on an array of lengths.
    """
    parts = edits + 1
    short, longer = length // parts, length % parts
    return [(i * short + np.maximum(0, i - parts + longer), short + (i >= parts - longer)) for i in range(parts)]


def shifts(edits: int) -> list[tuple[int, int, int]]:
    """Missing characters of the indexed line, place of its segment, and where the substring stands beside it.

    Edits to the left of the first unchanged segment, and to its right, are bounded by its place.
    """
    out = []
    for gap in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, gap - (edits - i)), min(i, gap + edits - i)
            out += [(gap, i, at) for at in range(low, high + 1)]
    return out


class Lines:
    """Some lines as one array of code points, with hashes of any substrings by prefix sums."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(self.points)
        with np.errstate(over="ignore"):
            self.back = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            self.back[0] = 1
            np.multiply.accumulate(self.back, out=self.back)
            powers = np.full(n, _BASE, dtype=np.uint64)
            powers[:1] = 1
            np.multiply.accumulate(powers, out=powers)
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((self.points + np.uint64(1)) * powers, dtype=np.uint64)])

    def keys(self, of: np.ndarray, at: np.ndarray, width: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """64-bit keys of the substrings of lines `of` that start at `at`, with a mark mixed in."""
        lo = self.start[of] + at
        with np.errstate(over="ignore"):
            h = (self.sums[lo + width] - self.sums[lo]) * self.back[lo]
            h = (h ^ (h >> np.uint64(32)) ^ mark.astype(np.uint64) * _MIX) * _MIX
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def segment_keys(self, edits: int) -> tuple[np.ndarray, np.ndarray]:
        """Line and key of every segment."""
        of = np.arange(len(self.size))
        made = [(of, self.keys(of, at, width, self.size * (edits + 1) + i)) for i, (at, width) in enumerate(segments(self.size, edits))]
        return np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])

    def probe_keys(self, edits: int) -> tuple[np.ndarray, np.ndarray]:
        """Line and key of every substring that may match a segment of an alike line."""
        of = np.arange(len(self.size))
        made = []
        for gap, i, beside in shifts(edits):
            at, width = segments(self.size - gap, edits)[i]
            made.append((of, self.keys(of, at + beside, width, (self.size - gap) * (edits + 1) + i)))
        return np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])

    def sketches(self, bits: int = 5) -> np.ndarray:
        """2**bits parity bits, in one or more 64-bit words, of each line's pairs of adjacent characters."""
        x, words = self.points, max(1, (1 << bits) // 64)
        out = np.zeros((len(self.size), words), dtype=np.uint64)
        if len(x) < 2:
            return out.view(np.int64)
        with np.errstate(over="ignore"):
            h = (x[:-1] * np.uint64(_BASE) + x[1:] * _MIX) >> np.uint64(64 - bits)
        bit = np.uint64(1) << (h & np.uint64(63))
        ends = self.start[1:] - 1
        for w in range(words):
            mine = np.append(np.where(h >> np.uint64(6) == w, bit, np.uint64(0)), np.uint64(0))
            mine[ends] = 0  # pairs across two lines
            out[:, w] = np.bitwise_xor.reduceat(mine, self.start)
        return out.view(np.int64)


def _ids(lines: list[str]) -> np.ndarray:
    """128-bit hashes, as two columns of 64-bit numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), dtype="<i8").reshape(-1, 2)


def _lines(text: str | None, least: int) -> list[tuple[int, str]]:
    """Place and stripped form of the lines that count."""
    return [(i, y) for i, x in enumerate((text or "").split("\n")) if len(y := x.strip(SPACES)) >= least]


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch, some SLICE characters at a time."""
    size = batch["text"].str.len().fillna(0).cumsum() // SLICE
    for _, part in batch.groupby(size.astype(int), sort=False):
        yield part


def _occurrences(exact: int):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                row, pos, lines = [], [], []
                for k, text in enumerate(part["text"]):
                    for i, line in _lines(text, exact):
                        row.append(k)
                        pos.append(i)
                        lines.append(line)
                ids = _ids(lines)
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy()[row], "key": part["key"].to_numpy()[row], "pos": np.array(pos, dtype=np.int32), "size": np.array([len(x) for x in lines], dtype=np.int32), "h": ids[:, 0], "g": ids[:, 1]})
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(again=pd.DataFrame({"row": row, "h": ids[:, 0], "g": ids[:, 1]}).duplicated().to_numpy())

    return run


def _distinct(batches: Iterator[pd.DataFrame], least: int) -> Iterator[list[str]]:
    """Lines of a task, a slice at a time; most repeats within the task are left out."""
    seen: set[int] = set()
    for batch in batches:
        for part in _slices(batch):
            new = {}
            for text in part["text"]:
                for _, line in _lines(text, least):
                    if (h := hash(line)) not in seen:
                        seen.add(h)
                        new[line] = None
            if len(seen) > 50_000:
                seen.clear()
            if new:
                yield [*new]


def _rows(least: int, edits: int, index: bool):
    """Index or probe rows of the lines of a task: key, line and sketch."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines in _distinct(batches, least):
            x = Lines(lines)
            of, key = x.segment_keys(edits) if index else x.probe_keys(edits)
            yield pd.DataFrame({"seg": key, "id": _ids(lines)[of, 0], "bits": x.sketches()[of, 0]})

    return run


@tidy
def _wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wide sketches of lines: 128 bits, to be cut into 4 * edits + 1 bands."""
    for batch in batches:
        for part in _slices(batch):
            yield pd.DataFrame({"id": part["id"].to_numpy(), "wide": Lines([*part["text"]]).sketches(7).tolist()})


def _texts(least: int):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines in _distinct(batches, least):
            ids = _ids(lines)
            yield pd.DataFrame({"h": ids[:, 0], "g": ids[:, 1], "line": lines})

    return run


def _banded(rows: DataFrame, wide: DataFrame, edits: int) -> DataFrame:
    """Rows of heavy segments, one for each band of the line's wide sketch."""
    bands = 4 * edits + 1
    size = 128 // bands + 1
    bit = lambda w, at: F.shiftrightunsigned(F.element_at("wide", w + 1), at)
    cut = []
    for i in range(bands):
        lo, hi = i * size, min(128, (i + 1) * size)
        parts = [bit(w, max(lo - 64 * w, 0)).bitwiseAND(F.lit((1 << (min(hi, 64 * w + 64) - max(lo, 64 * w))) - 1)) for w in (0, 1) if lo < 64 * w + 64 and hi > 64 * w]
        cut.append(F.xxhash64(F.lit(i), *parts))
    return rows.join(wide, "id").select("seg", "id", "wide", F.explode(F.array(*cut)).alias("band"))


def _second(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "id2", "bits": "bits2", "wide": "wide2", "line": "line2"})


def _crowded_links(index: DataFrame, probe: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Pairs id and id2 of lines within the edit distance that meet in a heavy segment; index and probe hold seg and id.

    Sketches meet first, on both sides as semi-joins, so that only lines with a partner carry their text.
    """
    wide = save(lines.select(F.col("h").alias("id"), F.col("line").alias("text")).mapInPandas(_wide, "id bigint, wide array<bigint>").dropDuplicates(["id"]), "line-wide")
    a, b = _banded(index, wide, edits), _second(_banded(probe, wide, edits))
    flips = sum((F.bit_count(F.element_at("wide", w).bitwiseXOR(F.element_at("wide2", w))) for w in (1, 2)), F.lit(0))
    same = (F.col("i.seg") == F.col("p.seg")) & (F.col("i.band") == F.col("p.band")) & (flips <= 4 * edits) & (F.col("id") != F.col("id2"))
    texts = lines.select(F.col("h").alias("id"), "line")
    left = a.alias("i").join(b.alias("p"), same, "left_semi").join(texts, "id")
    right = b.alias("p").join(a.alias("i"), same, "left_semi").join(_second(texts), "id2")
    within = F.levenshtein("line", "line2", edits) >= 0  # -1 beyond
    return left.alias("i").join(right.alias("p"), same & within).select("id", "id2")


def alike_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """Pairs (h, g) and (h2, g2) of 128-bit hashes of different lines within the edit distance, each pair once.

    Lines have `least` characters or more, at least 2 * edits + 1. Equal lines are one line; null and empty texts have
    none. Candidates carry half of the hash; pairs are settled on the lines themselves.
    """
    if least <= 2 * edits:
        raise ValueError("least must be above twice the edits")
    small_batches(docs.sparkSession)
    text = docs.select("text")
    kind = "seg bigint, id bigint, bits bigint"
    index = save(text.mapInPandas(_rows(least, edits, True), kind).dropDuplicates(["seg", "id"]), "line-index")
    crowded = save(index.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select("seg"), "line-heavy")
    probe = _second(text.mapInPandas(_rows(least, edits, False), kind))
    near = (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= 4 * edits) & (F.col("id") != F.col("id2"))
    pair = (F.least("id", "id2").alias("h"), F.greatest("id", "id2").alias("h2"))
    few = crowded.isEmpty()
    if few:
        hits = index.alias("i").join(probe.alias("p"), (F.col("i.seg") == F.col("p.seg")) & near)
    else:
        # a heavy segment is one row without id, which all that probes it meets
        marked = index.join(crowded, "seg", "left_anti").unionByName(crowded.select("seg", F.lit(None).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("bits")))
        met = marked.alias("i").join(probe.alias("p"), (F.col("i.seg") == F.col("p.seg")) & (F.col("id").isNull() | near))
        met = save(met.select(F.when(F.col("id").isNull(), F.col("i.seg")).alias("seg"), "id", "id2").distinct(), "line-met")
        hits = met.filter("id is not null")
    pairs = save(hits.select(*pair).distinct(), "line-pairs")
    ids = pairs.select("h").unionByName(pairs.select(F.col("h2").alias("h")))
    if not few:
        inside = index.join(crowded, "seg", "left_semi").select("seg", "id")
        probing = met.filter("id is null").select("seg", F.col("id2").alias("id"))
        ids = ids.unionByName(inside.select(F.col("id").alias("h"))).unionByName(probing.select(F.col("id").alias("h")))
    ids = save(ids.distinct(), "line-ids")
    lines = save(text.mapInPandas(_texts(least), "h bigint, g bigint, line string").join(ids, "h", "left_semi").dropDuplicates(["h", "g"]), "line-texts")
    if not few:
        pairs = save(_crowded_links(inside, probing, lines, edits).select(*pair).unionByName(pairs).distinct(), "line-pairs")
    both = pairs.join(lines, "h").join(lines.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("line2")), "h2")

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y, edits) <= edits for x, y in zip(a, b, strict=True)])

    return save(both.filter(within("line", "line2")).select("h", "g", "h2", "g2"), "line-links")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, exact: int = EXACT) -> DataFrame:
    """doc_id, key, lines, chars, links, dropped, kept_in and dropped_chars of documents with a line that counts.

    key is xxhash64 of the text; repeated rows give one row. lines and chars are of lines that count, links the links
    of their distinct lines, dropped the sorted places (from 0) of lines that go, kept_in for each of these a doc_id
    that has it or an alike line first. Rows without doc_id come last: they lose what others have, and nothing to each
    other. Null and empty texts have no lines.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    occurs = save(keyed.mapInPandas(_occurrences(min(exact, least)), "doc_id bigint, key bigint, pos int, size int, h bigint, g bigint, again boolean"), "lines")
    firsts = save(occurs.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "line-firsts")
    links = alike_lines(docs, edits, least)
    ends = links.join(firsts.select("h", "g", F.col("first").alias("first1")), ["h", "g"]).join(firsts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("first").alias("first2")), ["h2", "g2"])
    last = F.lit((1 << 63) - 1)
    order = lambda k, h, g: F.struct(F.coalesce(F.col(k), last), F.col(h), F.col(g))
    loses = order("first1", "h", "g") > order("first2", "h2", "g2")
    each = ends.select(F.explode(F.array(F.struct("h", "g", F.when(loses, F.col("first2")).alias("to"), loses.alias("loses")), F.struct(F.col("h2").alias("h"), F.col("g2").alias("g"), F.when(~loses, F.col("first1")).alias("to"), (~loses).alias("loses")))).alias("e")).select("e.*")
    each = each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("links"), F.max("loses").alias("loses"), F.min("to").alias("to"))
    # only lines that are repeated or linked are looked up; saved, so that both sides come from plain scans and a hot line's occurrences can be split
    told = save(firsts.join(each, ["h", "g"], "left").filter("n > 1 or links > 0"), "line-told")
    both = occurs.join(told, ["h", "g"], "left")
    gone = F.coalesce("loses", F.lit(False)) | F.col("again") | (F.col("n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    rows = both.select("doc_id", "key", "pos", "size", F.when(F.col("again"), 0).otherwise(F.coalesce("links", F.lit(0))).alias("links"), F.when(gone, F.least(F.coalesce("to", "first"), F.col("first"))).alias("to"), gone.alias("gone"))
    one = F.array_sort(F.collect_set(F.when(F.col("gone"), F.struct("pos", "to"))))
    counted = F.struct("pos", "size", "links", "gone")
    return (
        rows.groupBy("doc_id", "key").agg(F.collect_set(counted).alias("all"), one.alias("out"))
        .select("doc_id", "key", F.size("all").alias("lines"), F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("chars"), F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x.links).alias("links"), F.transform("out", lambda x: x.pos).alias("dropped"), F.transform("out", lambda x: x.to).alias("kept_in"), F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + F.when(x.gone, x["size"]).otherwise(0)).alias("dropped_chars"))
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: lines, links and dropped lines of every document, and the documents that have these lines first.

    class_id is the least of these and the document's own doc_id.
    """
    docs = table(spark, sf_dir, "documents")
    found = repeated_lines(docs).withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    both = docs.select("doc_id", F.xxhash64("text").alias("key")).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-"), F.lit(""))
    return both.select("doc_id", count(F.col("lines")).alias("n_lines"), count(F.col("links")).alias("n_links"), count(F.size("dropped")).alias("n_dropped"), listed("dropped").alias("dropped"), listed("kept_in").alias("kept_in"), F.least(F.col("doc_id"), F.array_min("kept_in")).alias("class_id"))


def drop_repeated_lines(docs: DataFrame, most: float = 0.8, **options) -> DataFrame:
    """Documents without their repeated lines. A document goes as a whole if no word is left, or if the lines that go
    hold more than `most` of all its characters (white space around lines aside, lines of any length); with most=1
    only the former. Columns as before; n_chars, if there, follows the text.
    """
    names = docs.columns
    found = repeated_lines(docs, **options).filter(F.size("dropped") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    both = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("key")), "left")
    others = F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.array_contains("dropped", i))
    left = F.aggregate(others, F.lit(0).cast("long"), lambda n, x: n + F.length(F.btrim(x, F.lit(SPACES))))
    both = both.withColumn("left", F.when(F.col("dropped").isNotNull(), left))
    kept = both.filter(F.coalesce((F.col("left") > 0) & (F.col("dropped_chars") <= most * (F.col("dropped_chars") + F.col("left"))), F.lit(True)))
    kept = kept.withColumn("rest", F.when(F.col("dropped").isNotNull(), F.array_join(others, "\n")).otherwise(F.col("row.text")))
    new = {"text": F.col("rest"), "n_chars": F.coalesce(F.length("rest"), F.lit(0)).cast("long")}
    same = lambda c: F.col("row").getField(c)
    return kept.select(*[(F.when(F.col("dropped").isNotNull(), new[c]).otherwise(same(c)) if c in new else same(c)).alias(c) for c in names])
