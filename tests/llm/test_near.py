import random

import __spark_entry__
import corpus_pipeline
from veriloom.llm.lsh_forest import drop_near_duplicates, near_duplicates, shingles


def words(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    sets, up = {i: words(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_against_all_pairs(spark):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for size in (1, 1, 3, 8, 60):  # a group of 60 whose members differ from one text by none to six words
        base = [random.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            x = list(base)
            for k in random.sample(range(120), random.choice((0, 0, 1, 1, 2, 3, 6)) if size > 1 else 0):
                x[k] = random.choice(vocabulary)
            docs.append((n, " ".join(x)))
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, "A b"), (n + 3, "a B"), (n + 4, "a b c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_dense_regions_are_cut(spark):
    random.seed(17)
    base, docs = [f"t{i}" for i in range(100)], []
    for k in range(150):  # a template: similarity about 0.65 to each other, and one of them with a near copy now and then
        x = base + [f"own{k}w{i}" for i in range(24)]
        docs.append((len(docs), " ".join(x)))
        if k % 5 == 0:
            docs.append((len(docs), " ".join([*x[:-1], "changed"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = brute(docs)
    assert sum(i != c for i, (_, c) in wanted.items()) == 30
    for dense in (500, 1 << 18):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, dense=dense).collect()} == wanted


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in __spark_entry__.queries()["op6_lsh_forest"](spark, data).collect()}
    assert got == brute(docs)


def test_shingles_are_sets_of_the_contract():
    for t in ("", "a", "a b c d", "A b c d e", "a b c d e f a b c d e f", "é x y"):
        assert len(shingles(t)) == len(words(t))


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = drop_near_duplicates(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert near_duplicates(none).count() == 0


def test_pipeline_stage_links_from_80(spark):
    random.seed(8)
    docs, lines = [], iter(range(10_000))
    for g in range(12):  # groups of a text and copies with 1 to 4 changed words, so similarities from 0.69 to 0.95
        base = [f"g{g}w{i}" for i in range(110)]
        for changed in (0, 1, 2, 3, 4):
            x = list(base)
            for k in random.sample(range(10, 100), changed):
                x[k] = f"new{next(lines)}"
            docs.append((len(docs), " ".join(x)))
    sets = {i: words(t) for i, t in docs}
    between = 0
    roots = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            between += 80 * union <= 100 * both < 85 * union
            if 100 * both >= 80 * union:
                x, y = sorted((roots[a], roots[b]))
                roots = {k: x if v == y else v for k, v in roots.items()}
    kept = {i for i in roots if roots[i] == i}
    assert between > 5
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in got} == kept
