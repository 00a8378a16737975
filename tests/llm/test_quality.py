import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veriloom.llm.common import save
from veriloom.llm.kn_quality import bands, base_rules, folded, gram_counts, judge, quality_filter, score


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_base_rules():
    random.seed(2)
    for _ in range(500):
        t = "".join(random.choice(["a ", "b ", "c\n", "é😀 ", "#", " ", "|\n", "\x0b", "\n", "d "]) for _ in range(random.randint(0, 130)))
        assert base_rules(t) == by_hand(t)
    assert base_rules(None) == (0, 0, 0, 0, 0, True)


def points(text):
    return [0] * 4 + folded(text).tolist() + [1]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.tables = {5: Counter(tuple(p[i : i + 5]) for p in map(points, texts) for i in range(len(p) - 4))}
        for k in (4, 3, 2, 1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1])
        self.off = {}
        for k, t in self.tables.items():
            n = [sum(v == j for v in t.values()) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            self.off[k] = [0.0, *(min(max(j + 1 - (j + 2) * y * n[j + 1] / n[j], 0.05), j + 0.95) if n[j] else 0.5 * (j + 1) for j in range(3))]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.tables[1]) + 1)
        d = self.off[k]
        mine = {g: n for g, n in self.tables[k].items() if g[:-1] == gram[:-1]}
        if not mine:
            return self.p(gram[1:])
        n = mine.get(gram, 0)
        return ((n - d[min(n, 3)]) + sum(d[min(v, 3)] for v in mine.values()) * self.p(gram[1:])) / sum(mine.values())

    def bits(self, text):
        p = points(text)
        return sum(-math.log2(self.p(tuple(p[i : i + 5]))) for i in range(len(p) - 4)) / (len(p) - 4)


def test_scores_against_plain_dictionaries(spark):
    random.seed(4)
    some = {"en": "aabbc e.", "日": "日本語の 。"}
    docs = [(i, " ".join("".join(random.choice(some[k]) for _ in range(5)) + "x" for _ in range(60)), k) for i, k in enumerate(["en", "日"] * 8)]
    docs.append((99, " ".join("Zq"[i % 2] + str(i) for i in range(60)), "en"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    half = {r["doc_id"]: r["half"] for r in df.collect()}
    models = {(k, h): Plain([t for i, t, lang in docs if lang == k and half[i] == h]) for k in some for h in (0, 1)}
    got = {r["doc_id"]: r["bits"] for r in score(df.select("doc_id", "text", "lang")).collect()}
    for i, t, k in docs:
        assert got[i] == pytest.approx(models[k, 1 - half[i]].bits(t), abs=0.002)


def test_chances_sum_to_one():
    random.seed(5)
    m = Plain(["".join(random.choice("abc d") for _ in range(300)) for _ in range(3)])
    for context in ((0, 0, 0, 0), (97, 98, 99, 97), (1, 2, 3, 4)):
        assert sum(m.p((*context, c)) for (c,) in m.tables[1]) + m.p((*context, 5)) == pytest.approx(1.0)


def test_packed_and_plain_counts_agree(monkeypatch):
    random.seed(3)
    texts = ["".join(chr(random.randrange(32, 20_000)) for _ in range(9000)) for _ in range(2)] + ["", "aB 12", "\x00\x01"]
    want = Counter(tuple(p[i : i + 5]) for p in map(points, texts) for i in range(len(p) - 4))
    for some in (texts, texts[2:]):
        a, b, n = gram_counts(some)
        got = {(x >> 21, x & (1 << 21) - 1, y >> 42, y >> 21 & (1 << 21) - 1, y & (1 << 21) - 1): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)}
        assert got == (want if some is texts else Counter(tuple(p[i : i + 5]) for p in map(points, some) for i in range(len(p) - 4)))


def test_bands_reject_what_the_language_does_not_explain(spark):
    random.seed(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("n", "r", "st", "la")]
    good = [(i, " ".join(random.choice(words) for _ in range(120)), "en") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{random.choice(words)}{random.choice(['###', '$$$', '%%%'])}" for _ in range(120)), "en") for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i] for i, *_ in bad) and sum(got[i] for i, *_ in good) >= 297


def test_bands_by_hand_and_every_language(spark):
    random.seed(9)
    rows = [(i, f"l{i % 70}", round(random.gauss(2, 0.2), 3)) for i in range(2100)]
    got = {r["model"]: (r["low"], r["high"]) for r in bands(spark.createDataFrame(rows, "doc_id long, model string, bits double"), 4, 3, 0.1).collect()}
    assert len(got) == 70
    for k, (low, high) in got.items():
        x = sorted(b for _, m, b in rows if m == k)
        q1, q2, q3 = (x[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
        assert (low, high) == pytest.approx((q2 - max(4 * (q2 - q1), 0.1), q2 + max(3 * (q3 - q2), 0.1)))


def test_query_keeps_what_rules_and_bands_say(spark, data):
    rows = __spark_entry__.queries()["op10_kn_quality"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == by_hand(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["low"] <= r["bits"] <= r["high"])


def test_files_as_they_are_and_written_first_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    read = {tuple(r) for r in score(save(docs.repartition(3), "t"), files=True).collect()}
    assert read == {tuple(r) for r in score(docs).collect()}


def test_odd_rows(odd, none):
    rows = judge(odd.select("doc_id", "text", "lang")).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_filter(odd).columns == odd.columns and quality_filter(none).count() == 0
