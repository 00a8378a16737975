"""Quality rules by n-gram perplexity.

Documents first pass plain rules on length and repetition. The characters of all that pass are counted as five-grams
by Spark, for each language; from the counts, Spark builds a modified Kneser-Ney model of each language, level by
level. Any character of any script counts as itself (letters in lower case, digits as 0), so that what is gathered
grows with the corpus. Texts fall into two halves by hash, and each half is scored by the model of the other one: no
text is predicted from itself, and copies fall into one half.

Nothing of the model is sent whole. Documents are read a file at a time; a file's grams are counted once for the
file, and the same rows ask for the file's answers: they are joined with the scored grams and written, as sorted
arrays of gram hashes with bits beside them, into one folder a file. The task that scores a file's documents opens
that folder only. So a task holds at most the distinct grams of one file, whatever the corpus.

Scores are bits per character. The bands of a language lie around the median of its documents, so many quartile
distances below and above; documents outside are rejected: below is text that repeats or lists, above is text that
the language doesn't explain.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import KEPT, MADE, save, shared_dir, small_batches, table, tidy

ORDER = 5
#: Bits of a character that no model explains: one code point among all.
UNKNOWN = 21.0
PAD, STOP = 0, 1
BLANKS = b" \t\n\x0b\x0c\r"
#: Characters that a task works on at once, and grams that it gathers before they are passed on.
SLICE, GATHERED = 1 << 20, 1 << 21
SALTS = 64
_MASK = (1 << 21) - 1


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text; digits count as 0, blanks and what is used for padding as a blank."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    x[(x >= 48) & (x <= 57)] = 48
    x[(x <= 32) & (x != 10)] = 32
    return x


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ORDER - 1 pads before and a stop behind each, and the number of five-grams of each: one for each
    character and one for its end."""
    pad, parts, sizes = np.full(ORDER - 1, PAD, dtype=np.uint32), [], []
    for t in texts:
        x = folded(t)
        parts += [pad, x, np.array([STOP], dtype=np.uint32)]
        sizes.append(len(x) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), np.array(sizes, dtype=np.int64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two and last three characters of each five-gram, 21 bits a character; grams that end in a pad are left out."""
    n = len(x) - ORDER + 1
    c = [x[k : n + k].astype(np.int64) for k in range(ORDER)]
    keep = c[-1] != PAD
    return ((c[0] << 21) | c[1])[keep], ((c[2] << 42) | (c[3] << 21) | c[4])[keep]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of grams, for sorted arrays."""
    with np.errstate(over="ignore"):
        h = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First two and last three characters of the distinct five-grams of some texts, and their counts."""
    x, _ = joined(texts)
    if not len(x):
        return (np.zeros(0, dtype=np.int64),) * 3
    seen = np.zeros(0x110000, dtype=bool)
    seen[x] = True
    letters = np.flatnonzero(seen)
    width = max(1, int(len(letters) - 1).bit_length())
    if width * ORDER > 63:  # too many kinds to pack five in one number
        a, b = _halves(x)
        h, at, n = np.unique(mixed(a, b), return_index=True, return_counts=True)
        return a[at], b[at], n
    place = np.zeros(0x110000, dtype=np.int64)
    place[letters] = np.arange(len(letters))
    y, n = place[x], len(x) - ORDER + 1
    packed = np.zeros(n, dtype=np.int64)
    for k in range(ORDER):
        packed = (packed << width) | y[k : n + k]
    packed, n = np.unique(packed[x[ORDER - 1 :] != PAD], return_counts=True)
    c = [letters[(packed >> (width * (ORDER - 1 - k))) & ((1 << width) - 1)] for k in range(ORDER)]
    return (c[0] << 21) | c[1], (c[2] << 42) | (c[3] << 21) | c[4], n


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    marks = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    repeat = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        pair = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 1 << 21:  # numbered anew, so that no product overflows
            pair = np.unique(pair, return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[back] > 1
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeat = int(cover.sum())
    return n, chars, marks, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def _slices(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, some SLICE characters at a time."""
    some, size = [], 0
    for k, t in enumerate(texts):
        some.append(k)
        size += len(t)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


@tidy
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the grams of a task's documents that pass the base rules, by file, language and half."""
    sums: dict[tuple, list] = {}
    size = 0

    def merge() -> int:
        """Puts each key's parts together; the number of grams that are left."""
        for key, parts in sums.items():
            if len(parts) > 1:
                a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, at, back = np.unique(mixed(a, b), return_index=True, return_inverse=True)
                sums[key] = [(a[at], b[at], np.bincount(back, weights=n).astype(np.int64))]
        return sum(len(parts[0][0]) for parts in sums.values())

    def flush() -> Iterator[pd.DataFrame]:
        merge()
        for (block, lang, half), [(a, b, n)] in sums.items():
            order = np.lexsort((b, a))
            yield pd.DataFrame({"block": block, "lang": lang, "half": half, "a": a[order], "b": b[order], "n": n[order]})
        sums.clear()

    for batch in batches:
        good = batch[[not base_rules(t)[-1] for t in batch["text"]]]
        for key, rows in good.groupby(["block", "lang", "half"], sort=False):
            texts = rows["text"].tolist()
            for some in _slices(texts):
                made = gram_counts([texts[k] for k in some])
                sums.setdefault(key, []).append(made)
                size += len(made[0])
        if size > GATHERED and (size := merge()) > GATHERED * 3 // 4:
            yield from flush()
            size = 0
    yield from flush()


_KEY = ["lang", "model"]


def _suffix(k: int) -> list[Column]:
    """The last k characters of a gram."""
    a = F.col("a").bitwiseAND(F.lit(_MASK)) if k == 4 else F.lit(0).cast("long")
    return [a.alias("a"), (F.col("b") if k >= 3 else F.col("b").bitwiseAND(F.lit((1 << 21 * k) - 1))).alias("b")]


def _context() -> list[Column]:
    """All characters of a gram but the last."""
    return [F.shiftright("a", 21).alias("ca"), F.shiftleft(F.col("a").bitwiseAND(F.lit(_MASK)), 42).bitwiseOR(F.shiftright("b", 21)).alias("cb")]


def levels(grams: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order, its grams with their discounted shares, and its contexts with the weight left to the order below.

    grams has lang, model, a, b, n, each gram once. The highest order goes by counts, those below by the number of
    characters before a gram. Discounts for one, two and more come from the counts of counts of language and order.
    """
    out, now = {}, grams
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            now = save(now.select(*_KEY, *_suffix(k)).groupBy(*_KEY, "a", "b").agg(F.count(F.lit(1)).alias("n")), f"kn-{k}", "zstd")
        n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        kinds = now.groupBy(*_KEY).agg(*n)
        y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        off = [F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5 * i)) for i in (1, 2, 3)]
        kinds = kinds.select(*_KEY, *[o.alias(f"d{i + 1}") for i, o in enumerate(off)])
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        by = Window.partitionBy(*_KEY, "ca", "cb")
        salted = kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a language may hold most rows
        rows = now.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).join(salted, [*_KEY, "salt"]).select(*_KEY, "a", "b", *_context(), "n", taken.alias("d"))
        rows = save(rows.select(*_KEY, "a", "b", ((F.col("n") - F.col("d")) / F.sum("n").over(by)).alias("share"), (F.sum("d").over(by) / F.sum("n").over(by)).alias("left")), f"kn-shares-{k}", "zstd")
        out[k] = rows.select(*_KEY, "a", "b", "share"), rows.select(*_KEY, *_context(), "left").dropDuplicates([*_KEY, "ca", "cb"])
    return out


def gram_bits(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """lang, model, a, b and bits of the grams asked for (lang, model, a, b, each once): minus log2 of the probability
    of the last character given those before, under the model that grams (lang, model, a, b, n) make."""
    model = levels(grams)
    chars = model[1][0].groupBy(*_KEY).agg((1.0 / (F.count(F.lit(1)) + 1)).alias("even"))
    wanted = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(*_KEY, *_suffix(k)).distinct()
    low = None
    for k in range(1, ORDER + 1):
        shares, contexts = model[k]
        rows = wanted[k].join(shares, [*_KEY, "a", "b"], "left").select(*_KEY, "a", "b", *_context(), "share").join(contexts, [*_KEY, "ca", "cb"], "left")
        if k == 1:
            rows = rows.join(chars, _KEY, "left").withColumn("p_low", F.coalesce("even", F.lit(2.0**-UNKNOWN)))
        else:
            under = low.select(*_KEY, F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("p_low"))
            sa, sb = _suffix(k - 1)
            rows = rows.withColumns({"sa": sa, "sb": sb}).join(under, [*_KEY, "sa", "sb"])
        low = save(rows.select(*_KEY, "a", "b", (F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p_low")).alias("p")), f"kn-p-{k}", "zstd")
    return low.select(*_KEY, "a", "b", (-F.log2("p")).alias("bits"))


def _open(root: str):
    """Sorted hashes and bits of one file's grams, by language and half."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(root)
    if files.get_file_info(path).type == fs.FileType.NotFound:  # no document of the file passes the base rules
        return {}
    rows = ds.dataset(path, filesystem=files, format="parquet").to_table(columns=["lang", "half", "a", "b", "bits"]).to_pandas()
    rows["h"] = mixed(rows["a"].to_numpy(), rows["b"].to_numpy())
    return {k: Sorted(x["h"].to_numpy(), x["bits"].to_numpy()) for k, x in rows.sort_values("h").groupby(["lang", "half"])}


class Sorted:
    """Bits of grams beside their sorted hashes. A first guess by the leading bits of a hash spares most searches."""

    def __init__(self, hashes: np.ndarray, bits: np.ndarray):
        self.hashes, self.bits = hashes, bits
        self.shift = np.uint64(64 - max(1, int(4 * len(hashes)).bit_length()))
        self.guess = np.zeros(1 << int(np.uint64(64) - self.shift), dtype=np.int32)
        self.guess[hashes >> self.shift] = np.arange(len(hashes), dtype=np.int32)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        at = self.guess[h >> self.shift]
        miss = np.flatnonzero(self.hashes[at] != h)
        at[miss] = np.minimum(np.searchsorted(self.hashes, h[miss]), len(self.hashes) - 1)
        got = self.bits[at]
        got[miss[self.hashes[at[miss]] != h[miss]]] = UNKNOWN
        return got


def text_bits(texts: list[str], known: Sorted) -> np.ndarray:
    """Bits per character of each text."""
    x, sizes = joined(texts)
    got = known.look_up(mixed(*_halves(x))).astype(np.float64)
    return np.add.reduceat(got, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes


def score(docs: DataFrame, keep=("doc_id",), files: bool = False) -> DataFrame:
    """The kept columns, the base rules' columns, lang and bits per character (null where base_failed).

    files says that docs is read from files as it is; otherwise it is written first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs if files else save(docs.select(*dict.fromkeys((*keep, "text", "lang"))), "quality-docs")
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))
    place = [F.xxhash64(F.input_file_name()).alias("block"), lang.alias("lang"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half")]
    counted = save(docs.select(*place, text.alias("text")).mapInPandas(_count, "block bigint, lang string, half int, a bigint, b bigint, n bigint"), "grams", "zstd")
    grams = save(counted.groupBy("lang", "half", "a", "b").agg(F.sum("n").alias("n")), "gram-counts", "zstd")
    other = (1 - F.col("half")).alias("model")
    found = gram_bits(grams.select("lang", F.col("half").alias("model"), "a", "b", "n"), grams.select("lang", other, "a", "b"))
    found = found.select("lang", (1 - F.col("model")).alias("half"), "a", "b", F.round("bits", 3).cast("float").alias("bits"))
    root = f"{shared_dir(spark)}/gram-bits-{uuid.uuid4().hex}"
    answers = counted.select("block", "lang", "half", "a", "b").join(found, ["lang", "half", "a", "b"]).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(8)))
    keys = ["block", "part", "lang", "half", "a", "b"]
    answers = answers.repartition("block", "part").dropDuplicates(keys).sortWithinPartitions(*keys).drop("part")  # one shuffle for both; sorted rows take less room
    answers.write.option("compression", "zstd").partitionBy("block").parquet(root)

    @F.pandas_udf("struct<n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, bits double>")
    @tidy
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        opened, known = None, {}
        for batch in batches:
            rows = pd.DataFrame(dict(zip(("block", "lang", "half", "text"), batch, strict=True)))
            out = pd.DataFrame([base_rules(t) for t in rows["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
            bits = np.full(len(rows), np.nan)
            failed = out["base_failed"].to_numpy()
            for (block, lang, half), part in rows.groupby(["block", "lang", "half"], sort=False):
                at = [k for k in part.index if not failed[k]]
                if not at:
                    continue
                if block != opened:
                    opened, known = block, {}  # one file at a time
                    known = _open(f"{root}/block={block}")
                for some in _slices(texts := rows["text"].iloc[at].tolist()):
                    bits[[at[k] for k in some]] = text_bits([texts[k] for k in some], known[lang, half])
            yield out.assign(bits=np.where(np.isnan(bits), None, bits.round(3))).astype({"bits": "Float64"})

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias(KEPT)
    rows = docs.select(kept, *place, text.alias("text")).select(KEPT, "lang", run("block", "lang", "half", "text").alias(MADE))
    return rows.select(*[F.col(f"{KEPT}.`{c}`") for c in keep], F.col("lang").alias("model"), f"{MADE}.*")


def bands(scored: DataFrame, below: float, above: float, least: float) -> DataFrame:
    """model, low and high: the median of bits less and plus so many distances to the lower and upper quartile.

    Quartiles are exact: bits have three decimals, so that a language has few distinct values, whose counts are
    summed. A distance is at least `least` bits in all, for languages whose documents are nearly alike.
    """
    counts = scored.filter(F.col("bits").isNotNull() & ~F.isnan("bits")).groupBy("model", "bits").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("model")
    share = F.sum("n").over(by.orderBy("bits")) / F.sum("n").over(by)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bits")))
    got = counts.withColumn("share", share).groupBy("model").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    gap = lambda a, b, k: F.greatest((F.col(b) - F.col(a)) * k, F.lit(least))
    return got.select("model", (F.col("q2") - gap("q1", "q2", below)).alias("low"), (F.col("q2") + gap("q2", "q3", above)).alias("high"))


#: Quartile distances below and above the median, and the least width of each in bits.
BELOW, ABOVE, WIDTH = 8.0, 6.0, 0.1


def judge(docs: DataFrame, keep=("doc_id",), files: bool = False, below: float = BELOW, above: float = ABOVE, width: float = WIDTH) -> DataFrame:
    """Scores with kept: whether the base rules pass and bits lie in the band of the language.

    Nulls: a null text has no words and fails; a null language is the language of the empty name. A text of any length
    is scored whole; equal texts of one language score alike. Every language has its own model and band.
    """
    scored = save(score(docs, keep, files), "quality")
    limits = bands(scored, below, above, width).withColumnRenamed("model", "of")
    both = scored.join(limits, F.col("model") == F.col("of"), "left")
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & inside).drop("of")


def op10(spark, sf_dir: str) -> DataFrame:
    """Query: base rules, perplexity and verdict of every document."""
    got = judge(table(spark, sf_dir, "documents"), files=True)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "model", "bits", "low", "high")


def quality_filter(docs: DataFrame, files: bool = False, **options) -> DataFrame:
    """The documents that are kept; columns as before, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")
    return judge(rows, keep=("row",), files=files, **options).filter("kept").select("row.*")
