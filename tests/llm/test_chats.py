"""Structure repair and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from veriloom.llm import chat_repair, prefix_trie
from veriloom.llm.chat_repair import END, costs, damaged, layers, repair, segment_costs, trace
from veriloom.llm.prefix_trie import trie, turn_rows, with_shared_openings


def cheapest(turns):
    """Cost and audit of a list of (role, fault) by keeping the least (cost, audit) of every state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                to = 3 if s == 2 else 2
                best[to] = min(best.get(to, (1e9, "")), (c + 3, a + "I"))
        return best

    for role, fault in turns:
        after = {}
        for s, (c, a) in inserted(best).items():
            ways = [(s, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways.append((3 if s == 2 else 2, c + 3 + more, a + "R"))
                if (s, role[:1]) in step:
                    ways.append((step[s, role[:1]], c + more, a + "K"))
            for to, *way in ways:
                after[to] = min(after.get(to, (1e9, "")), tuple(way))
        best = after
    return min(w for s, w in inserted(best).items() if s in (0, 3))


def plain_repair(rows):
    """All that repair returns of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        turns.append((role, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
        seen.add((role, text))
    cost, audit = cheapest(turns)
    state, out, at = 0, [], iter(rows)
    for e in audit:
        row = next(at) if e != "I" else None
        if e == "K":
            state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
            out.append(f"{row[1]}:{row[2]}")
        elif e in "IR":
            state = 3 if state == 2 else 2
            out.append(f"{'user' if state == 2 else 'assistant'}:{row[2] if row else ''}")
    numbers = {r[0] for r in rows if r[0] is not None}
    faults = [f for _, f in turns]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_layers():
    rng = random.Random(1)
    for _ in range(400):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(0, 12))]
        letters = "".join("D" if f == "blank" else x.upper() if f else x for r, f in turns for x in [r[0] if r[0] in "sua" else "x"])
        found = layers(letters, END)
        cost, audit = cheapest(turns)
        got, state = trace(letters, found, 0)
        assert (costs(found)[0], got + "I" * (END[state] // 3)) == (cost, audit)
        if letters:
            k = rng.randrange(1, len(letters) + 1)
            ends = costs(layers(letters[k:], END)) if letters[k:] else list(END)
            t = segment_costs(letters[:k])
            assert [min(t[4 * s + e] + ends[e] for e in range(4)) for s in range(4)] == costs(found)


@pytest.mark.parametrize("segment", [3, 64])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(chat_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", ""], ["Yes.", "No", "", " \n", "Why?\n", "é!", "one. two", "x" * 5000, "."]
    rows = [(str(c), rng.choice([None, *range(-3, 300)]), rng.choice(roles), rng.choice(texts) + str(rng.choice(["", i])) * (i % 2)) for c in range(40) for i in range(rng.choice([1, 2, 5, 9, 40]))]
    rows += [("long", i, ["user", "assistant"][(i + i // 7) % 2], f"{i}.") for i in range(700)] + rows[:30]
    df = spark.createDataFrame([(*r, 1, "", 2) for r in rows], "conv string, turn long, role string, text string, pos int, letter string, seg int").repartition(4)
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r.conv: tuple(r)[1:] for r in repair(df.select("conv", "turn", "role", "text")).collect()} == want
    assert repair(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (5, None) for t in (*range(60), None)] + [(7, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        want += [(key.split(":")[0], t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_trie(convs):
    """Nodes of {conv: [(role, text), ...]} by walking over all prefixes."""
    members, out = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0 if p in children else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for q in children.get(p, []):
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        below(())
    return sorted(out.values(), key=str)


def rebuilt(rows):
    ordered = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        ordered.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in ordered.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = ordered.get(base, [])[:h] + own[h:]
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    rows = [(c, rng.choice([None, *range(600)]), rng.choice(["user", "assistant", None]), rng.choice(["é", "", None, "ab", "abc"])) for c in range(-7, 60) if c != 10 for _ in range(rng.choice([1, 2, 4, 8, 14]))]
    rows += [(100 + k, i, "user", f"turn {i if k % 5 < 3 or i < 15 + k else -i}") for k in range(10) for i in range(40)] + [(None, 1, "user", "x")] + rows[:9]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(4)
    nodes = trie(*with_shared_openings(turn_rows(df)))
    assert sorted((tuple(r) for r in nodes.drop("digest").collect()), key=str) == plain_trie(rebuilt(rows))
    assert nodes.select("depth", "digest").distinct().count() == nodes.count()
    assert trie(*with_shared_openings(turn_rows(df.limit(0)))).collect() == []


def test_ids_in_pieces(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    ids = [(0, b"", i) for i in range(9)] + [(1, b"x", 3)] + [(2, b"y", i) for i in range(4)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("depth", "digest", "conv_id"), r, strict=True)) for r in ids[k : k + 5]]) for k in range(0, len(ids), 5)]
    pieces = [r for b in prefix_trie._pieces(iter(batches)) for r in b.to_pylist()]
    assert max(len(p["ids"].split(",")) for p in pieces) == 4
    hashed = {r["digest"]: r["ends_sha256"] for b in prefix_trie._hashed(iter([pa.RecordBatch.from_pylist(pieces)])) for r in b.to_pylist()}
    want = {k: hashlib.sha256(",".join(str(r[2]) for r in ids if r[1] == k).encode()).hexdigest() for k in (b"", b"x", b"y")}
    assert hashed == want
