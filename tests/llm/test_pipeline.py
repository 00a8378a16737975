import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from veriloom.llm.kn_quality import base_rules, judge
from veriloom.llm.line_dedup import EXACT, LEAST, _ids, _lines, edit_distance


@pytest.fixture(scope="module")
def stages(spark, data):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.save(stage(spark, docs, data), name)
        out.append((docs, got))
        docs = got
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(stages):
    for k, (before, after) in enumerate(stages):
        assert k == 4 or after.columns == before.columns
    sizes = [stages[0][0].count(), *(after.count() for _, after in stages)]
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4]


def test_quality_by_hand(stages):
    before, after = stages[0]
    bits = {r["doc_id"]: r for r in judge(before).collect()}
    kept = texts(after)
    for i, t in texts(before).items():
        r = bits[i]
        assert (i in kept) == (not base_rules(t)[-1] and r["low"] <= r["bits"] <= r["high"])
    assert all(kept[i] == t for i, t in texts(before).items() if i in kept)


def test_lines_by_hand(stages):
    before, after = stages[1]
    docs, first = texts(before), {}
    for i in sorted(docs):
        for _, line in _lines(docs[i], EXACT):
            first.setdefault(line, i)
    order = lambda x: (first[x], *_ids([x])[0].tolist())
    loses, by_size = set(), {}
    for x in first:
        by_size.setdefault(len(x), []).append(x)
    for n, some in by_size.items():
        for a in some if n >= LEAST else []:
            for m in (n, n + 1, n + 2):
                loses |= {max(a, b, key=order) for b in by_size.get(m, []) if a != b and edit_distance(a, b, 2) <= 2}
    wanted = {}
    for i, t in docs.items():
        seen, rest = set(), []
        for line in t.split("\n"):
            x = line.strip(" \t\n\x0b\x0c\r")
            if len(x) >= EXACT and (x in seen or first[x] != i or x in loses):
                continue
            seen.add(x)
            rest.append(line)
        if any(x.strip(" \t\n\x0b\x0c\r") for x in rest) or not any(len(x) >= EXACT for x in t.split("\n")):
            wanted[i] = "\n".join(rest)
    assert texts(after) == wanted and sum(map(len, wanted.values())) < sum(map(len, docs.values()))


def test_near_duplicates_by_hand(stages):
    before, after = stages[2]
    sets = {}
    for i, t in texts(before).items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert set(texts(after)) == {i for i in root if root[i] == i}


def test_mix_nears_its_targets(stages):
    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    words, taken = Counter(), Counter()
    rows = [(r["source"], size(r["text"])) for r in before.collect()]
    for s, n in rows:
        words[s] += n
    for r in after.collect():
        taken[r["source"]] += size(r["text"])
    # targets by hand: weights in code-point order, three times the size at most, the excess shared again
    weights = dict(zip(sorted(words), (5, 2, 1) * len(words), strict=False))
    target, open_, left = {}, dict(weights), sum(words.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 3 * words[s]]
        if not full:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * words[s]
            left -= target[s]
            del open_[s]
    assert all(abs(taken[s] - target[s]) <= max(n for x, n in rows if x == s) for s in words)


def test_tokens_of_the_whole(stages):
    before, after = stages[4]
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = texts(before)
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode(own[r["doc_id"]], add_special_tokens=False).ids for r in rows)


def test_run_gives_the_last_stage(spark, data, stages):
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, data).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[-1][1].collect())


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_odd_rows_through_all_stages(spark, odd, none, data):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.save(stage(spark, docs, data), name)
