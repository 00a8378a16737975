import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
import corpus_pipeline
from veriloom.llm import line_dedup
from veriloom.llm.line_dedup import EXACT, Lines, _ids, _lines, alike_lines, drop_repeated_lines, edit_distance, repeated_lines, segments


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert edit_distance(a, b, k) == min(table(a, b), k + 1)


@settings(max_examples=500, deadline=None)
@given(st.text("ab", min_size=8, max_size=20), st.integers(1, 3), st.randoms())
def test_no_pair_is_missed(a, k, rnd):
    b = list(a)
    for _ in range(k):
        b[rnd.randrange(len(b))] = rnd.choice(["", "a", "c", "ab"]) or ""
        b = list("".join(b)) or ["a"]
    x, y = sorted((a, "".join(b)), key=len)
    if len(x) > 2 * k and table(x, y) <= k:
        one, two = Lines([x, "another line"]), Lines(["some line before", y])
        index = {key for of, key in zip(*one.segment_keys(k), strict=True) if of == 0}
        assert index & {key for of, key in zip(*two.probe_keys(k), strict=True) if of == 1}
        for bits in (5, 7):
            flips = one.sketches(bits)[0] ^ two.sketches(bits)[1]
            assert sum(bin(int(w) & (2**64 - 1)).count("1") for w in flips) <= 4 * k


def test_keys_are_of_substrings():
    x = Lines(["abcdefghij", "xxabcdefghijyy", ""])
    where = lambda of, at, n, mark: x.keys(*(np.array([v]) for v in (of, at, n, mark)))[0]
    assert where(0, 2, 5, 7) == where(1, 4, 5, 7) != where(1, 5, 5, 7) and where(0, 2, 5, 7) != where(0, 2, 5, 8)
    assert [(int(a), int(n)) for a, n in segments(10, 2)] == [(0, 3), (3, 3), (6, 4)]


def brute(docs, edits, least, exact):
    first = {}
    for i, t in docs:
        for _, line in _lines(t, exact):
            first[line] = min(first.get(line, i), i)
    order = lambda x: (first[x], *_ids([x])[0].tolist())
    links, to = dict.fromkeys(first, 0), {}
    for a in first:
        for b in first:
            if a < b and min(len(a), len(b)) >= least and table(a, b) <= edits:
                links[a], links[b] = links[a] + 1, links[b] + 1
                best, worse = sorted((a, b), key=order)
                to[worse] = min(to.get(worse, first[best]), first[best])
    out = {}
    for i, t in docs:
        seen, gone, kept, n = set(), [], [], 0
        for p, line in _lines(t, exact):
            n += 0 if line in seen else links[line]
            if line in seen or first[line] != i or line in to:
                gone.append(p)
                kept.append(min(first[line], to.get(line, first[line])))
            seen.add(line)
        out[i] = (n, gone, kept)
    return out


@pytest.mark.parametrize("edits", [1, 2])
def test_against_all_pairs(spark, edits):
    random.seed(edits)
    base = ["".join(random.choice("abcde ") for _ in range(random.randint(12, 20))).strip() + "xyz" for _ in range(12)]
    lines = base + [x[:5] + "q" + x[6:] for x in base] + [x + "!" for x in base[:6]] + [x[1:] for x in base[:4]] + ["short 1", "short 2", "tiny"]
    docs = [(i, "\n".join(random.choice(lines) for _ in range(random.randint(0, 6)))) for i in range(40)]
    got = {r["doc_id"]: (r["links"], r["dropped"], r["kept_in"]) for r in repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits, 10, 5).collect()}
    wanted = brute(docs, edits, 10, 5)
    assert got == {i: wanted[i] for i, t in docs if _lines(t, 5)}


def test_heavy_segments_lose_no_link(spark):
    random.seed(11)
    half = "the first half of this line is the same in all of them, "
    lines = [half + "".join(random.choice("abcdefgh ") for _ in range(60)).strip("  ") + "." for _ in range(120)]
    lines += [x[:70] + "Z" + x[71:-3] + x[-2:] for x in lines[:30]] + [f"user number {i:05d} has logged in from the house" for i in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    name = {tuple(_ids([x])[0].tolist()): i for i, x in enumerate(lines)}
    wanted = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if table(lines[a], lines[b]) <= 2}
    for heavy in (20, 100_000):
        got = [tuple(sorted((name[r["h"], r["g"]], name[r["h2"], r["g2"]]))) for r in alike_lines(df, heavy=heavy).collect()]
        assert len(got) == len(wanted) and set(got) == wanted and len(wanted) > 100


def test_near_copies_make_rows_of_links_only(spark, monkeypatch):
    random.seed(5)
    words = random.sample([a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzABCD"], 300)
    base = "every one of these lines is a copy of one line, in which a single {} stands for another word, and no more than that."
    lines = [base.format(x) for x in words] + [base.format(x)[:-1] for x in words[:20]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    made, save = {}, line_dedup.save
    monkeypatch.setattr(line_dedup, "save", lambda df, name, *a: made.setdefault(name, []).append(out := save(df, name, *a)) or out)
    got = alike_lines(df).collect()
    name = {tuple(_ids([x])[0].tolist()): i for i, x in enumerate(lines)}
    wanted = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if edit_distance(lines[a], lines[b], 2) <= 2}
    assert len(got) == len(wanted) and {tuple(sorted((name[r["h"], r["g"]], name[r["h2"], r["g2"]]))) for r in got} == wanted
    settled = made["line-pairs"][-1].count()  # all 51,040 pairs share two segments of three, and most are three edits apart
    assert 10_000 < len(wanted) <= settled < 1.5 * len(wanted)


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op3_line_dedup"](spark, data).collect()
    assert len(rows) == len(texts) and any(r["n_dropped"] for r in rows)
    first = {}
    for i in sorted(texts):
        for _, line in _lines(texts[i], EXACT):
            first.setdefault(line, i)
    for r in rows:
        gone = [int(x) for x in r["dropped"].split(",") if x]
        lines = dict(_lines(texts[r["doc_id"]], EXACT))
        assert {p for p, x in lines.items() if first[x] != r["doc_id"]} <= set(gone) <= set(lines)
        assert len(lines) == r["n_lines"] and r["class_id"] == min([r["doc_id"], *(int(x) for x in r["kept_in"].split(",") if x)])


def test_odd_rows(odd, none):
    kept = drop_repeated_lines(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids  # a copy goes, and so does each repeat of it
    assert {3, 4, 5, 6, 7, 8, 9} <= set(ids) and ids.count(None) == 1  # the text without doc_id comes last, so that its lines go
    assert drop_repeated_lines(none).count() == 0


def test_short_unique_lines_stay(spark):
    header = "Licensed under the terms of the licence found beside this file."
    long = [f"a line of document {i} that no other document has at all, {'x' * i}" for i in (1, 6)]
    code = "\n".join(f"v{i} = {i}" for i in range(40))
    docs = [(0, header), (1, f"{header}\n{code}"), (2, f"  {header}\t\n\n \n"), (3, "\n".join([header, header + "!"] * 4 + long)), (4, header + "\nend"), (5, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    rest = {0: header, 1: code, 3: "\n".join(long), 4: "end", 5: None}
    assert {r["doc_id"]: r["text"] for r in drop_repeated_lines(df, most=1).collect()} == rest
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == rest
    got = drop_repeated_lines(df).collect()  # 0.8 of the whole text: 40 short lines are more than a fifth, "end" isn't
    assert {r["doc_id"] for r in got} == {0, 1, 5} and all(r["n_chars"] == len(r["text"] or "") for r in got)
