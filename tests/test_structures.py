"""Operators that keep state, indexes and versions: orders of arrival, replays, ties and odd rows."""

import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from veriloom.operators import coordination, retrieval, versions
from veriloom.sources.shared import shared_dir
from veriloom.streaming import cache, flows, sweep


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(30)]
        for j in range(rng.choice([1, 2, 5, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(30)] = rng.choice(words)
            if j % 4 == 3:
                rng.shuffle(text)
            n = len(rows)
            rows.append((n, f"https://x.com/User_{n % 6}/status/{(200_000_000_000 + n * 240_000) << 22}", " ".join(text)))
    rows += [(1000, "https://x.com/a/status/12", "too early an id"), (1001, "https://example.com/", "no account"), (1002, "https://twitter.com/b/statuses/1800000000000000000", ""), (1003, None, None)]
    return spark.createDataFrame(rows, "id long, url string, text string")


def clusters_of(frame):
    """Sets of posts of a table with post and cluster."""
    out = {}
    for r in frame.select("post", "cluster").collect():
        out.setdefault(r.cluster, set()).add(r.post)
    return {frozenset(v) for v in out.values()}


def test_clusters_in_any_order(spark, items):
    rows = coordination.posts(items, "id", "url", "text")
    whole = coordination.analyse(rows, 0.8)
    want = clusters_of(whole)
    assert max(map(len, want)) > 3 and sum(map(len, want)) == rows.count() < items.count()
    scores = {(r.posts, r.accounts, r.first, r.last, r.score) for r in coordination.summed(coordination.seen(whole, "cluster")).collect()}
    based = rows.withColumn("base", F.when(F.col("post") % 3 > 0, F.lit(0.4)))
    for order in (F.col("post"), -F.col("post"), F.xxhash64("post")):
        kept = coordination.Campaigns(spark, f"{shared_dir(spark)}/c-{uuid.uuid4().hex}", coordination.idf(rows), 0.8)
        parts = [[r.post for r in based.select("post").orderBy(order).collect()][k::3] if k < 3 else [] for k in range(4)]
        for i, part in enumerate([*parts, parts[0]]):  # the last batch brings nothing new
            kept.add(based.filter(F.col("post").isin(part)), i)
            if i == 1:  # run again, as after a failure
                kept.add(based.filter(F.col("post").isin(part)), i)
        assert clusters_of(kept.verdicts()) == want
        assert {(r.posts, r.accounts, r.first, r.last, r.score) for r in kept.clusters().collect()} == scores
        assert kept.stored("verdicts").filter("batch = 4").count() == 0
        got = kept.verdicts().join(based, "post").collect()
        assert all(r.score == round((0.25 * r.base + 0.1 * r.signal) / 0.35 if r.base is not None else r.signal, 4) for r in got)


def test_signal(items, spark):
    rows = coordination.analyse(coordination.posts(items, "id", "url", "text"), 0.8)
    one = coordination.signal(coordination.summed(coordination.seen(rows, "cluster")), rows).first()
    assert one.available and one.score > 0 and one.n_clusters > 0 and one.summary.endswith("minutes")
    none = coordination.analyse(coordination.posts(items.limit(0), "id", "url", "text"))
    assert tuple(coordination.signal(coordination.summed(coordination.seen(none, "cluster")), none).first())[:4] == (0.0, False, 0, 0)


def test_ranking(spark):
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.choice([3, 10, 40, 200])))) for i in range(400)]
    texts += [(500 + i, texts[7][1]) for i in range(5)] + [(600, ""), (601, None)]
    queries = [(i, " ".join(texts[i * 11][1].split()[:12])) for i in range(20)] + [(90, "unknown word"), (91, None), (92, "c1")]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "id long, text string")

    bags = {i: re.findall(r"\w\w+", (x or "").lower()) for i, x in texts}
    bags = {i: b for i, b in bags.items() if b}
    mean = sum(map(len, bags.values())) / len(bags)
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1

    def score(words, b):
        return round(sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in words if w in b), 6)

    want = []
    for k, x in queries:
        words = set(re.findall(r"\w\w+", (x or "").lower()))
        ranked = sorted((-score(words, b), i) for i, b in bags.items() if words & set(b))
        want += [(k, i, -s, n + 1) for n, (s, i) in enumerate(ranked[:7])]
    for block in (4, 64):
        index = retrieval.build(t, "id", "text", block)
        got = sorted(tuple(r) for r in retrieval.rank(index, q, "id", "text", 7).select("query", "id", "score", "place").collect())
        assert [(a, b, pytest.approx(c, abs=2e-6), d) for a, b, c, d in got] == sorted(want)
    assert retrieval.skipped(retrieval.build(t, "id", "text", 4), q, "id", "text", 7) > 0.2  # blocks are left out
    empty = retrieval.build(t.limit(0), "id", "text")
    assert retrieval.rank(empty, q, "id", "text", 7).count() == 0


def test_cache_by_time(spark):
    base = 1_704_067_200_000_000
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), base + rng.randrange(0, 40_000) * 1_000_000) for i in range(300)] + [(900, "a", base), (901, "a", base), (902, "z", base + 90_000_000_000)]
    path = f"{shared_dir(spark)}/look-{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "id long, key string, us long").select("id", "key", F.timestamp_micros("us").alias("ts"))
    for k in range(3):
        df.filter(F.least(F.lit(2), F.floor((F.unix_micros("ts") - base) / 15e9)) == k).coalesce(1).write.mode("append").parquet(path)
    with cache.state_store(spark):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = sorted(((r.key, r.at, r.outcome, r.id) for r in flows.run_to_table(cache.cached(stream, "key", "id", "ts", 1800, "10 minutes")).collect()), key=str)
    want, until = [], max(r[2] for r in rows) - 600_000_000
    for key in ("a", "b", "z"):
        stored = None
        for us, i in [*sorted((r[2], r[0]) for r in rows if r[1] == key), (1 << 60, None)]:
            if stored is not None and us >= stored + 1_800_000_000:
                want.append((key, stored + 1_800_000_000, "expiry", None))
                stored = None
            if i is not None:
                want.append((key, us, "miss" if stored is None else "hit", i))
                stored = us if stored is None else stored
    assert got == sorted((w for w in want if w[1] < until), key=str)


def test_sweep(spark):
    top = f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"
    put = lambda name, *lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{top}/{name}")
    run = lambda: sweep.sweep(spark, {"a": f"{top}/a", "b": f"{top}/b", "c": f"{top}/c"}, f"{top}/store", "k", "n")
    put("a", '{"k":"x","n":1}', '{"k":"y","n":2}', "{broken", "", '{"n":5}', '{"k":"z"}', "[1]", "{broken")
    put("b", '{"k":"x","n":10}')
    run()
    put("a", '{"k":"x","n":1}', '{"k":"x","n":3,"v":"new"}', '{"k":"x","n":3,"v":"other"}', "{broken")
    put("c", '{"k":7,"n":"4"}')
    run()
    run()
    rows = {(r.source, r.key, r.mark, r.body) for r in sweep.stored(spark, f"{top}/store", "rows").collect()}
    assert rows == {("a", "x", 1, '{"k":"x","n":1}'), ("a", "y", 2, '{"k":"y","n":2}'), ("a", "x", 3, '{"k":"x","n":3,"v":"new"}'), ("b", "x", 10, '{"k":"x","n":10}'), ("c", "7", 4, '{"k":7,"n":"4"}')}
    bad = sorted((r.source, r.cause, r.line) for r in sweep.stored(spark, f"{top}/store", "bad").collect())
    assert bad == [("a", "no_key", '{"n":5}'), ("a", "no_mark", '{"k":"z"}'), ("a", "not_json", "[1]"), ("a", "not_json", "{broken")]
    assert {tuple(r) for r in sweep.summary(spark, f"{top}/store").collect()} == {("a", 3, 3, 1, 4), ("b", 10, 1, 0, 0), ("c", 4, 1, 0, 0)}


def test_versions(spark):
    folder = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    old = spark.range(1500).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("n"))
    new = old.filter("k not between 1000 and 1004").withColumn("v", F.when(F.col("k") == 1321, "other").otherwise(F.col("v"))).withColumn("n", F.when(F.col("k") == 70, 0).otherwise(F.col("n"))).unionByName(spark.sql("select 900000 as k, 'far' as v, cast(null as bigint) as n"))
    ranges = F.floor(F.col("k") / 10)
    for version, rows in ((1, old), (2, new), (3, old.repartition(7)), (4, old.limit(0))):
        versions.snapshot(rows, "k", ranges, folder, version)
    assert {r.range for r in versions.changed_ranges(spark, folder, 1, 2).collect()} == {7, 100, 132, 90000}
    got = {(r.key, r.change, r.was and r.was.v, r.now and r.now.v) for r in versions.differences(spark, folder, 1, 2).collect()}
    assert got == {*((k, "removed", f"v{k}", None) for k in range(1000, 1005)), (1321, "changed", "v1321", "other"), (70, "changed", "v70", "v70"), (900000, "added", None, "far")}
    assert versions.differences(spark, folder, 1, 3).count() == 0
    assert [(r.change, r["count"]) for r in versions.differences(spark, folder, 4, 1).groupBy("change").count().collect()] == [("added", 1500)]


def test_as_of(spark):
    v = spark.sql("select * from values ('a', date'2024-01-10', 1), ('a', date'2024-03-05', 2), ('a', date'2024-03-20', 3), ('b', date'2024-02-29', 4) as t(k, since, n)")
    days = [("a", "2024-01-09"), ("a", "2024-01-10"), ("a", "2024-03-04"), ("a", "2024-03-05"), ("a", "2024-03-19"), ("a", "2024-03-20"), ("a", "2025-12-31"), ("a", "2025-12-31"), ("b", "2024-02-28"), ("b", "2024-02-29"), ("c", "2024-05-01"), (None, "2024-05-01"), ("a", None)]
    claims = spark.createDataFrame(days, "k string, day string").withColumn("day", F.to_date("day"))
    got = [r.n for r in versions.as_of(claims.repartition(1), v, "k", "day").orderBy(F.col("k").asc_nulls_last(), F.col("day").asc_nulls_last()).collect()]
    assert got == [None, 1, 1, 2, 2, 3, 3, 3, None, None, 4, None, None]


def test_ranking_keeps_one_row_a_text(spark, monkeypatch):
    """Words are never shuffled by text; queries in parts, repeated ids and ties give the same places."""
    texts = [(i, f"w{i % 7} common w{i % 3} x{i}") for i in range(60)] + [(5, "w1 w1 more"), (7, "common"), (99, None)]
    t = spark.createDataFrame(texts, "id long, text string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", f"common w{i % 7} w{i % 3} x{i} nothing") for i in range(30)], "id string, text string")
    index = retrieval.build(t, "id", "text")
    assert index.table("texts").count() == 60 and index.postings.count() == index.table("texts").selectExpr("sum(size(words))").first()[0]
    want = sorted(map(tuple, retrieval.rank(index, q, "id", "text", 4).collect()))
    monkeypatch.setattr(retrieval, "CELLS", 40)
    assert sorted(map(tuple, retrieval.rank(index, q, "id", "text", 4).collect())) == want and len(want) == 120
