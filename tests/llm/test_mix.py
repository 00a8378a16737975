import pytest
from pyspark.sql import functions as F

from veriloom.llm.cube_mixing import cube_mix, mix_documents, mixing_units


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """By hand: share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w, total = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values())
    capped = set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        out = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_and_balance(spark):
    rows = [(i, "ab cd ef " * (i * 37 % 90 + 1), s) for i, s in enumerate(["a"] * 3000 + ["b"] * 900 + ["é"] * 50 + [None] * 20 + ["z"] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cube_mix(mixing_units(docs), block_rows=256).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    wanted, taken = targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(0.002 * t, 5), (s, t, taken[s])
    for s in ("a", "b", "z"):  # the number of documents is balanced as well
        n, share = sum(r["source"] == s for r in got), wanted[s] / sizes[s]
        assert abs(sum(r["copies"] for r in got if r["source"] == s) - n * share) <= 8
    again = cube_mix(mixing_units(docs.repartition(7)), block_rows=256).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_rows(odd, none):
    assert mix_documents(odd).columns == odd.columns
    mixed = cube_mix(mixing_units(odd))
    assert mixed.agg(F.sum("copies")).first()[0] > 0 and mixed.filter("size = 0 and copies > 0").isEmpty()
    assert mix_documents(none).count() == 0 and cube_mix(mixing_units(none)).count() == 0
