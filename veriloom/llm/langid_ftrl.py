"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, letters lower-cased and all else folded to blanks, fall into buckets. Document
frequencies are counted over all learning documents. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample, and a temperature is set on the part of the sample that the fit hasn't
seen. The sample holds distinct texts only, `sample` // languages of each language and at least one; it is drawn in
Spark by the order of a hash, before anything is collected. Every language is learned: there are so many buckets, a
power of two up to DIMS, that buckets times languages stay within CELLS (with 256 buckets at least), which bounds what
the fit holds and what is sent to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import MADE, save, small_batches, table

DIMS, CELLS, SAMPLE = 1 << 16, 1 << 22, 4000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all that is no letter being one blank a run."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    low = text.lower()
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters[0][np.minimum(x, 0xFFFF)]
    if len(x) and x.max() > 0xFFFF:
        for k in np.flatnonzero(x > 0xFFFF).tolist():
            is_letter[k] = low[k].isalpha()
    x = np.where(is_letter, x, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a letter stays
    return x[keep].astype(np.uint64)


def buckets_for(languages: int) -> int:
    """Number of buckets for so many languages."""
    return max(256, min(DIMS, 1 << int(np.log2(CELLS / max(languages, 1)))))


def features(text: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, sorted, and their counts; empty if it has no letter. dims is a power of two."""
    x = fold(text)
    if not len(x):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    x = np.concatenate([np.array([32], dtype=np.uint64), x])
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams, h = [], x * a
    for n in (1, 2, 3):
        if n > 1:
            if len(x) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * b + x[n - 1 :] * a
        z = (h ^ (h >> np.uint64(31))) * b
        grams.append((z >> np.uint64(64 - int(dims).bit_length() + 1)).astype(np.int64))
    counts = np.bincount(np.concatenate(grams), minlength=dims)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, of length one."""
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader, with L1 and L2 penalties."""

    def __init__(self, classes: int, dims: int = DIMS, alpha=0.8, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        g2 = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g2


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, langs: list[str], epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and temperature from lang, buckets and counts of each sampled document."""
    place = {k: i for i, k in enumerate(langs)}
    data = [(np.asarray(at), weigh(np.asarray(at), np.asarray(c), idf), place[k]) for k, at, c in rows]
    turn, seen = [], dict.fromkeys(place, 0)
    for k, *_ in rows:  # every fifth document of a language is held out, so that each language is learned
        seen[k] += 1
        turn.append(seen[k] % 5 == 0)
    held, learned = [x for x, out in zip(data, turn, strict=True) if out] or data, [x for x, out in zip(data, turn, strict=True) if not out]
    model, rng = Ftrl(len(langs), len(idf)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(learned)).tolist():
            model.learn(*learned[i])
    w = model.weights(slice(None))
    scores, labels = np.array([x @ w[at] for at, x, _ in held]), np.array([k for *_, k in held])
    wanted = np.full((len(labels), len(langs)), 1.0 / (len(labels) + len(langs)))  # one more of each: never quite certain
    wanted[np.arange(len(labels)), labels] += len(labels) / (len(labels) + len(langs))
    loss = lambda t: -(wanted * np.log(softmax(scores / t) + 1e-12)).sum(axis=1).mean()
    grid = np.geomspace(0.05, 5, 60)
    return w, float(grid[int(np.argmin([loss(t) for t in grid]))])


def _frequencies(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(dims + 1, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                at, _ = features(text, dims)
                sums[at] += 1
                sums[dims] += bool(len(at))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": sums[at]})

    return run


def _sampled(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t, dims) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "order": batch["order"], "at": [a.tolist() for a, _ in got], "counts": [c.tolist() for _, c in got]})

    return run


def draw(rows: DataFrame, each: int) -> DataFrame:
    """lang, order and text of `each` distinct texts of every language (all, where there are fewer), the least by hash.

    Rows have text and lang, neither null. A share of the hashes, by the number of a language's distinct texts, leaves
    somewhat more than needed in one pass; only these are grouped, and only one text of each hash goes on.
    """
    keyed = rows.select("lang", F.xxhash64("text", "lang").alias("order"), "text")
    sizes = keyed.select("lang", "order").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(each + 6 * each**0.5 + 8) / F.col("n")).alias("share"))
    some = keyed.join(save(sizes, "lang-sizes"), F.col("lang") == F.col("of")).filter(F.pmod("order", F.lit(1 << 24)) < F.col("share") * (1 << 24))
    some = save(some.groupBy("lang", "order").agg(F.min("text").alias("text")), "lang-sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    return some.withColumn("place", place).filter(F.col("place") <= each).drop("place")


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model of a table with text and lang; None if no row has both, the text with a letter.

    Rows without text, without lang or without a letter teach nothing; copies of a text teach once. Languages whose
    drawn texts all lack letters aren't learned.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select("text", "lang")
    languages = rows.select("lang").distinct().count()
    if not languages:
        return None
    dims = buckets_for(languages)
    counts = save(rows.select("text").mapInPandas(_frequencies(dims), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")), "frequencies").toPandas()
    seen = np.zeros(dims + 1)
    seen[counts["bucket"]] = counts["n"]
    idf = np.log((1 + seen[dims]) / (1 + seen[:dims])) + 1.0
    got = draw(rows, max(1, sample // languages)).mapInPandas(_sampled(dims), "lang string, order bigint, at array<int>, counts array<bigint>").toPandas()
    got = got[got["at"].map(len) > 0].sort_values(["order", "lang"], kind="stable")
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    w, t = fit(list(zip(got["lang"], got["at"], got["counts"], strict=True)), idf, langs)
    return {"langs": langs, "idf": idf.astype(np.float32), "weights": w.astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict | None, keep=("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of the whole text of every row.

    A null text or one without a letter is UNKNOWN with score 0, and so is everything without a model.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            rows = []
            for text in batch:
                at, counts = features(text or "", len(m["idf"]) if m else DIMS)
                if m is None or not len(at):
                    rows.append((UNKNOWN, 0.0))
                    continue
                p = softmax(weigh(at, counts, m["idf"]) @ m["weights"][at] / m["temperature"])
                k = int(p.argmax())
                rows.append((m["langs"][k], round(min(float(p[k]), 1.0), 6)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.select(*keep, run(F.col("text")).alias(MADE)).select(*keep, f"{MADE}.*")


def op9(spark, sf_dir: str) -> DataFrame:
    """Query: predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
